"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, bands, exact checks.

A text's words (split at white space, lower case) give a multiset of five-word shingles; a text of fewer words is one
shingle. Weights are discretised at the integers. Each shingle carries, for each dyadic interval of weights
[0,1), [1,2), [2,4), ..., a Poisson process whose points have a time, a weight level and a signature component;
a point counts if its level lies below the shingle's count, so a process is split along the weights
exactly where two counts differ. The earliest point of each component is its signature value; two texts agree in a
component with a probability equal to their weighted Jaccard similarity. Points are made in order of
time and only up to the time by which all components are filled, so most shingles cost one draw.

Equal texts share a node. Nodes that agree in a band meet in a bucket. First each node is checked against the bucket's pivot (its
least node) by the true multiset overlap, and the links found are closed to classes by alternating star contractions. In most
buckets all nodes are then of one class. In the others the nodes outside the pivot's class are compared with all nodes of
other classes, in parts of bounded size (_bucket_links), and the classes are closed again. No row is made for a pair that isn't a link,
and no bucket is gathered in one task.

Defined cases: rows with a null or wordless text are classes of their own. Equal rows and equal texts share a class.
The class id is the least doc_id in the class. An empty table gives no row. Extra columns are left out, and
kept by drop_near_duplicates(). Nodes are 64-bit hashes of the normalised text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, task_batches

M, ROWS, DEALS = 128, 8, 4  # components; per band; partitions of the components into bands
WORDS = 5


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1) from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Words(dict):
    """word -> 64-bit hash; bounded."""

    def __missing__(self, w):
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """(text number, hash) of every shingle, repeats included, text by text; and each text's node."""
    import xxhash

    words, sizes, nodes = [], np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        ws = t.lower().split() if t else []
        sizes[i] = len(ws)
        nodes.append(xxhash.xxh3_64_intdigest(" ".join(ws)) - (1 << 63) if ws else None)
        words.append(np.fromiter(map(_WORDS.__getitem__, ws), np.uint64, len(ws)))
    w = np.concatenate([*words, np.zeros(WORDS, np.uint64)])
    n = len(w) - WORDS
    h = np.zeros(n, np.uint64)
    for j in range(WORDS):
        h = _mix(h * np.uint64(3) + w[j : n + j])
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words from here to the text's end
    whole = left >= WORDS
    for i in np.flatnonzero((sizes > 0) & (sizes < WORDS)):  # one shingle, of the words there are
        at = int(sizes[:i].sum())
        x = np.full(1, sizes[i], np.uint64)
        for j in range(sizes[i]):
            x = _mix(x * np.uint64(3) + w[at + j : at + j + 1])
        h[at], whole[at] = x[0], True
    return doc[whole], h[whole], nodes


def _counted(doc: np.ndarray, h: np.ndarray):
    """Distinct (text, hash) and their counts, text by text."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    first = np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]))) if len(d) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return d[at], x[at], np.diff(np.concatenate((at, [len(d)])))


def multiset_as_set(doc: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text its shingles as distinct hashes: the k-th repeat of a shingle has a hash of its own, so set overlap is multiset overlap."""
    d, x, c = _counted(doc, h)
    rep = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    out = np.where(rep == 0, np.repeat(x, c), _mix(np.repeat(x, c) + np.uint64(0x9E3779B97F4A7C15) * rep.astype(np.uint64))).view(np.int64)
    return np.split(out, np.cumsum(np.bincount(np.repeat(d, c), minlength=n))[:-1])


def _points(doc, h, lo, size, weight, limit, sig_time, sig_id, n):
    """Adds the points up to each text's time limit."""
    times, active, j = np.zeros(len(doc)), np.arange(len(doc)), 0
    base = _mix(h + np.uint64(0x9E3779B97F4A7C15) * (lo.astype(np.uint64) + np.uint64(1)))
    slots, ts, ids = [], [], []
    while len(active):
        # Many draws at once where many points are due, one where most elements stop at the first.
        due = float((M * size[active] * (limit[doc[active]] - times[active])).mean())
        k = int(max(1, min(64, due, 250_000 // len(active))))  # bounded memory
        step = np.arange(j, j + k, dtype=np.uint64)
        a = _mix(base[active][:, None] + np.uint64(0xD1342543DE82EF95) * (step + np.uint64(1)))
        t = times[active][:, None] + np.cumsum(-np.log(_unit(a)) / (M * size[active])[:, None], axis=1)
        within = t <= limit[doc[active]][:, None]
        r, c = np.nonzero(within)
        e, b = active[r], _mix(a[r, c] ^ np.uint64(0xA0761D6478BD642F))
        level = lo[e] + ((b >> np.uint64(20)).astype(np.float64) * 2.0**-44 * size[e]).astype(np.int64)
        counts = level < weight[e]
        e, r, c, b = e[counts], r[counts], c[counts], b[counts]
        slots.append(doc[e] * M + (b & np.uint64(M - 1)).astype(np.int64))
        ts.append(t[r, c])
        ids.append(b)
        go = within[:, -1]
        times[active] = t[:, -1]
        active, j = active[go], j + k
    slot, t, i = np.concatenate(slots), np.concatenate(ts), np.concatenate(ids)
    np.minimum.at(sig_time, slot, t)
    won = t == sig_time[slot]
    sig_id[slot[won]] = i[won]


def signatures(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, M) signature values and whether a text has any shingle."""
    d, x, c = _counted(doc, h)
    total = np.bincount(d, weights=c, minlength=n)
    top = int(c.max()) if len(c) else 0
    parts = [(np.arange(len(d)), 0, 1)]
    lo = 1
    while lo < top:
        parts.append((np.flatnonzero(c > lo), lo, lo))
        lo *= 2
    el = np.concatenate([p[0] for p in parts])
    lows = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
    size = np.concatenate([np.full(len(p[0]), float(p[2])) for p in parts])
    sig_time, sig_id = np.full(n * M, np.inf), np.zeros(n * M, np.uint64)
    limit = (np.log(M) + 5) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        use = todo[d[el]]
        _points(d[el[use]], x[el[use]], lows[use], size[use], c[el[use]], limit, sig_time, sig_id, n)
        todo = todo & np.isinf(sig_time.reshape(n, M)).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return sig_id.reshape(n, M), total > 0


def _deals() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(5))
    return np.concatenate([rng.permutation(M) for _ in range(DEALS)]).reshape(-1, ROWS)


def bands(sig: np.ndarray) -> np.ndarray:
    """(n, bands) keys; a band's number is part of its keys."""
    deal = _deals()
    key = np.broadcast_to(np.arange(len(deal), dtype=np.uint64)[None, :], (len(sig), len(deal))).copy()
    for j in range(ROWS):
        key = _mix(key * np.uint64(3) + sig[:, deal[:, j]])
    return key.view(np.int64)


def _sketch(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, th (hash of the raw text), node, keys."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("th", T.LongType()), T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        for table in task_batches(batches, None, 2048, 2 << 20):
            doc, h, nodes = shingles(table["text"].to_pylist())
            # Repeats inside a batch are sketched once.
            number, first = {}, np.zeros(len(nodes), bool)
            for i, x in enumerate(nodes):
                first[i] = x is not None and number.setdefault(x, i) == i
            keep = first[doc]
            sig, has = signatures(doc[keep], h[keep], len(nodes))
            keys = bands(sig)
            lists = [keys[number[x]] if x is not None else None for x in nodes]
            yield from pa.table([table["doc"], table["th"], pa.array(nodes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["doc", "th", "node", "keys"]).to_batches()

    return rows.mapInArrow(run, schema)


def _shingle_sets(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame) -> DataFrame:
    """node, set (multiset as set) of the nodes listed with a document and its raw text hash: only that row's text is fetched, and of rows equal in both any one."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    met = rows.join(nodes, (F.col("doc").eqNullSafe(F.col("one"))) & (rows["th"] == nodes["th"])).select("node", "text")
    one = met.groupBy("node").agg(F.first("text").alias("text"))
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        for table in task_batches(batches, None, 2048, 2 << 20):
            doc, h, _ = shingles(table["text"].to_pylist())
            yield from pa.table([table["node"], pa.array(multiset_as_set(doc, h, table.num_rows), pa.list_(pa.int64()))], names=["node", "set"]).to_batches()

    return one.mapInArrow(run, schema)


#: Keys that hold more than 1 in HOT of a table's rows are joined apart; there are at most HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with one, which has a row per key and that key's number of rows, n. At most HOT keys have more than one in HOT of
    the rows (a class that holds a third of a corpus); their rows of `one`, a proven small list, are broadcast, so their rows stay where they
    lie; no other key is large."""
    total = one.agg(F.sum("n")).first()[0] or 0
    hot = one.filter(F.col("n") > max(total / HOT, 16))
    keys = hot.select(key)
    many = rows.join(F.broadcast(hot.drop("n")), key)
    few = rows.join(F.broadcast(keys), key, "left_anti").join(one.drop("n"), key, how)
    return many.unionByName(few, allowMissingColumns=True)


def classes_of(links: DataFrame) -> DataFrame:
    """(node, least node of its connected component) from links (a, b), by large-star and small-star contractions."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = join_hot(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        small = join_hot(large, low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = materialize(small, "small")
        state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        done = state(small) == state(edges)
        for t in (edges, least, large, low):
            discard(t)
        edges = small
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def link_group(nodes: np.ndarray, roots: np.ndarray, main: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of a group, at most one fewer than nodes. Only pairs of different classes are compared, unless both are of the
    bucket's main class; a pair whose sizes rule the threshold out is not compared."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    bits = np.zeros((len(sets), -(-len(every) // 64)), np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    np.bitwise_or.at(bits, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    _, label = np.unique(roots, return_inverse=True)
    out = []
    for i in np.flatnonzero(~main):
        other = np.flatnonzero((label != label[i]) & (np.minimum(sizes, sizes[i]) >= threshold * np.maximum(sizes, sizes[i])))
        for lo in range(0, len(other), 256):
            part = other[lo : lo + 256]
            inter = np.bitwise_count(bits[part] & bits[i]).sum(axis=1)
            for j in part[inter >= threshold * (sizes[part] + sizes[i] - inter)]:
                if label[j] != label[i]:
                    out.append((int(nodes[i]), int(nodes[j])))
                    label[label == label[j]] = label[i]
    return out


def _bucket_links(members: DataFrame, roots: DataFrame, sets: DataFrame, threshold: float, weight: int = 120_000) -> DataFrame:
    """Links (a, b) between different classes inside buckets that the stars left open.

    A bucket's nodes are those of its pivot's class (main) and others. Others are compared with all nodes. A bucket of more than
    `weight` shingles is cut into parts: each part of the others meets each part of the main nodes and each part of the
    others in a task of its own, so no task holds more than two parts, and a bucket in which almost all is joined costs little
    more than its own rows.
    """
    of = lambda df, c: df.join(roots.withColumnsRenamed({"node": c, "root": f"{c}_root"}), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    nodes = members.select("key", "node", "pivot").union(members.select("key", F.col("pivot").alias("node"), "pivot").distinct())
    nodes = of(of(nodes, "node"), "pivot").join(sets.select("node", F.size("set").cast("long").alias("size")), "node")
    main = F.col("node_root") == F.col("pivot_root")
    count = lambda c: F.greatest(F.lit(1), F.ceil(c / weight)).cast("int")
    open_ = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~main).alias("n_other"), F.sum(F.when(~main, F.col("size")).otherwise(0)).alias("w_other"), F.sum(F.when(main, F.col("size")).otherwise(0)).alias("w_main"))
    # A bucket of two has been checked by its star.
    open_ = open_.filter("n > 2 AND n_other > 0").select("key", count(F.col("w_other")).alias("p_other"), count(F.col("w_main")).alias("p_main"), (F.col("w_other") + F.col("w_main") <= weight).alias("small"))
    rows = nodes.join(open_, "key").select("key", "node", F.col("node_root").alias("root"), main.alias("main"), "p_other", "p_main", "small")
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n)).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_main = F.transform(span("p_main"), lambda j: F.struct(part("p_other").alias("i"), j.alias("j")))
    with_other = F.transform(span("p_other"), lambda i: F.struct(F.least(i, part("p_other")).alias("i"), (-1 - F.greatest(i, part("p_other"))).alias("j")))
    places = F.when(F.col("small"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).when(F.col("main"), F.transform(span("p_other"), lambda i: F.struct(i.alias("i"), part("p_main").alias("j")))).otherwise(F.concat(with_main, with_other))
    dealt = rows.select("key", "node", "root", "main", F.explode(places).alias("at")).select("key", "at.i", "at.j", "node", "root", "main").join(sets, "node")

    def link(group):
        import pyarrow as pa

        sets_ = [np.asarray(x) for x in group["set"].to_numpy()] if group.num_rows else []
        found = link_group(group["node"].to_numpy(), group["root"].to_numpy(), np.array(group["main"].to_pylist(), bool), sets_, threshold)
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return dealt.groupBy("key", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicate_rows(docs: DataFrame, *, doc_id="doc_id", text="text", threshold=0.8) -> DataFrame:
    """doc, th, node and class_id of every row."""
    rows = materialize(_sketch(docs, doc_id, text), "sketch")
    nodes = materialize(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("least"), F.min(F.struct("doc", "th")).alias("r")).select("node", "least", F.col("r.doc").alias("one"), F.col("r.th").alias("th")), "nodes")
    spread = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "pivot")
    members = materialize(spread.join(shared, "key").filter("node <> pivot").select("key", "node", "pivot"), "members")
    inside = materialize(members.select("node").union(members.select(F.col("pivot").alias("node"))).distinct(), "inside")
    sets = materialize(_shingle_sets(docs, doc_id, text, nodes.join(inside, "node").select("node", "one", "th")), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        """(node, pivot, sim) of distinct pairs."""
        left = pairs.select("node", "pivot").distinct().join(sets, "node")
        both = left.join(sets.select(F.col("node").alias("pivot"), F.col("set").alias("other")), "pivot")
        # The overlap is worked out once: a filter on it would be pushed below and do it again.
        sim = F.transform(F.array(F.size(F.array_intersect("set", "other"))), lambda n: n / (F.size("set") + F.size("other") - n))[0]
        return both.select("node", "pivot", sim.alias("sim"))

    stars = materialize(checked(members).filter(F.col("sim") >= threshold).select(F.col("node").alias("a"), F.col("pivot").alias("b")), "stars")
    roots = materialize(classes_of(stars), "roots")
    links = stars.union(materialize(_bucket_links(members, roots, sets, threshold), "links"))
    roots = materialize(classes_of(links), "roots")
    label = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    label = materialize(label.select("node", "root", "least"), "label")
    least = materialize(label.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n")), "class")
    named = join_hot(label, least, "root").select("node", "class_id")
    return rows.select("doc", "th", "node").join(named, "node", "left").withColumn("class_id", F.coalesce("class_id", "doc"))


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id and class_id, the least doc_id of its class."""
    doc_id = options.get("doc_id", "doc_id")
    return near_duplicate_rows(docs, **options).select(F.col("doc").alias(doc_id), "class_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row for each class: the one of the least doc_id."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    rows = materialize(near_duplicate_rows(docs, **options), "classes")
    kept = rows.filter(F.col("doc").eqNullSafe(F.col("class_id")))
    kept = kept.groupBy("class_id", F.coalesce("node", "th").alias("node")).agg(F.min("th").alias("th"), F.count(F.lit(1)).alias("n"))
    kept = materialize(kept, "kept")
    out = docs.withColumn("__lexmill_th", F.xxhash64(text)).join(kept.select(F.col("class_id").alias("__lexmill_id"), F.col("th").alias("__lexmill_h")), F.col(doc_id).eqNullSafe(F.col("__lexmill_id")) & (F.col("__lexmill_th") == F.col("__lexmill_h")), "left_semi")
    if kept.filter("n > 1").limit(1).count():  # repeated rows: one of each stays
        out = out.dropDuplicates([doc_id, "__lexmill_th"])
    return out.drop("__lexmill_th")
