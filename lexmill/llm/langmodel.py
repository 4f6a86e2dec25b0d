"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed word model of order `order` (3) with an unknown-word class. Its states are the contexts of up to order - 1
words (and the begin mark) that training holds. State h has an arc for each word w that training holds after it, of weight
  log10 (c(h w) + mu p(w | h')) / (c(h) + mu),
which leads to the longest state that h w ends with, and one failure arc of weight log10 mu / (c(h) + mu) to the state of its
longest proper suffix h'. The root has an arc for each known word, p(w) = (c(w) - d) / N, and one for the unknown class, d V / N (d from
the counts of words seen once and twice), so each state's probabilities sum to 1. One left-to-right traversal of a text carries the
state and adds up the weights of the arcs that it takes, failure arcs included. As a state depends on order - 1 words only, long texts are
walked in segments that read order - 1 words ahead; all segments of a block step together.

The n-grams of a corpus fit no single memory, so neither counts nor automaton are gathered in one place.
Each task turns its documents into blocks of about `block_bytes` of text (word numbers and the block's vocabulary), written once. Each block
asks, for the distinct n-grams it holds (hashed to BITS bits, sorted, in slices by hash), for the training counts; each slice of the hash
range sums what the blocks have counted and answers every block; a block's answers are the part of the automaton that
its texts can reach, which is built and walked in one task. A block sends at most 2^FAN slices of each order, whatever the corpus: where slices
must be finer, groups of blocks are merged per slice, and the merged keys ask further as blocks do. What is shuffled grows with
the corpus, a task's memory with the block (or with one text longer than a block).

Defined cases: a null or empty text is the end token alone. Repeated rows count and are scored one by one. Without a
training token every word is unknown and scores are 0. An empty table gives no row.
Extra columns are ignored. Words are split at ASCII white space, A-Z in lower case.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
END, BEGIN = np.uint64(0x51ED270B), np.uint64(0x2545F491)
BITS = 56  # of the hashes by which n-grams are told apart
FAN = 13  # bits of a hash by which one level of asking is cut
GROUP = 64  # blocks that are merged where slices must be finer
SEGMENT = 256  # words of a text that one lane of the walk reads


class _Numbers(dict):
    """word -> its number in a block."""

    def __missing__(self, w):
        n = self[w] = len(self)
        return n


def numbered(text: str | None, numbers: _Numbers) -> np.ndarray:
    """The words of a text and the end token (None) by number."""
    ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    x = np.empty(len(ws) + 1, np.int64)
    x[:-1] = np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws))
    x[-1] = numbers[None]
    return x


def word_hashes(numbers: _Numbers) -> np.ndarray:
    import xxhash

    return np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngrams(vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray, order: int):
    """For order 1, 2, ... in turn, of the n-grams that end at each place of a block's texts (they may begin with one begin mark): their places, their
    sorted distinct hashes, the place of one of each, the distinct number of every place."""
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(start, sizes)
    word_keys = _mix(vocabulary + np.uint64(0x7F4A7C15))
    every, _, number = _distinct(word_keys >> np.uint64(64 - BITS))
    number = number[codes]
    some = np.zeros(len(every), np.int64)
    some[number] = np.arange(len(codes))
    yield np.arange(len(codes)), every, some, number
    key, w = word_keys[codes], vocabulary[codes]
    for n in range(2, order + 1):
        before = np.empty_like(key)
        before[1:] = key[:-1]
        if n == 2:
            before[start] = BEGIN
        key = _mix(before * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(n))
        at = np.flatnonzero(place >= n - 2)
        every, some, number = _distinct(key[at] >> np.uint64(64 - BITS))
        yield at, every, at[some], number


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, the place of one of each, the distinct number of every place)."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return k[new], order[new], number


def _pack(x: np.ndarray) -> bytes:
    """Unsigned integers as the bytes that all but one in 200 need, all lowest bytes first; the others stand whole behind, with their places."""
    x = np.ascontiguousarray(x, "<u8")
    most = int(np.partition(x, k)[k]) if (k := len(x) - 1 - len(x) // 200) >= 0 else 0
    n = max(1, (most.bit_length() + 7) // 8)
    far = np.flatnonzero(x >> np.uint64(8 * n)) if n < 8 else np.zeros(0, np.int64)
    return bytes([n]) + len(far).to_bytes(4, "little") + far.astype("<u4").tobytes() + x[far].tobytes() + x.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    n, m = b[0], int.from_bytes(b[1:5], "little")
    planes = np.frombuffer(b, np.uint8, offset=5 + 12 * m).reshape(n, -1)
    x = np.zeros((planes.shape[1], 8), np.uint8)
    x[:, :n] = planes.T
    x = x.view("<u8").ravel()
    x[np.frombuffer(b, "<u4", m, 5)] = np.frombuffer(b, "<u8", m, 5 + 4 * m)
    return x


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.uint64)


_ASK = T.StructType([T.StructField("slice", T.LongType()), T.StructField("member", T.LongType()), T.StructField("order", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_REPLY = T.StructType([T.StructField("member", T.LongType()), T.StructField("order", T.IntegerType()), T.StructField("slice", T.LongType()), T.StructField("counts", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("tokens", "kinds", "once", "twice"))])


def _table(schema: T.StructType, rows: list[tuple]):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    cols = [*zip(*rows)] if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)


def _asks(keys: np.ndarray, counts: np.ndarray, member: int, order: int, done: int, bits: int):
    """Rows of _ASK for sorted keys that agree in their first `done` bits, in slices by the next `bits`."""
    if not len(keys):
        return
    rest = BITS - done - bits
    base = np.uint64(int(keys[0]) >> (rest + bits) << bits)
    cut = [0, *np.searchsorted(keys >> np.uint64(rest), base + np.arange(1, 1 << bits, dtype=np.uint64)), len(keys)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield int(keys[a]) >> rest, member, order, _pack_sorted(keys[a:b]), _pack(counts[a:b])


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their summed counts, the distinct number of every key of the lists in a row)."""
    every, _, back = _distinct(np.concatenate(keys))
    return every, np.bincount(back, weights=np.concatenate(counts), minlength=len(every)).astype(np.uint64), back


def _answer(table):
    """Sums one slice of one order over all members, and answers each in its own key order."""
    keys = [_unpack_sorted(x) for x in table["keys"].to_pylist()]
    _, total, back = _sum(keys, [_unpack(x) for x in table["counts"].to_pylist()])
    got = np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])
    sums = (int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()))
    # A slice's sums stand in one of its rows.
    rows = zip(table["member"].to_pylist(), table["order"].to_pylist(), table["slice"].to_pylist(), got)
    return _table(_REPLY, [(m, o, s, _pack(g), *(sums if i == 0 else (0, 0, 0, 0))) for i, (m, o, s, g) in enumerate(rows)])


def _resolve(asks: DataFrame, members: int, done: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(replies to all members, the replies of the finest slices, which hold the sums). The asks are cut by `done` bits, `bits` more are needed."""
    if bits <= 0:
        leaf = materialize(asks.groupBy("slice", "order").applyInArrow(_answer, _REPLY), "counts")
        return leaf, leaf
    asks, step = materialize(asks, "asks"), min(bits, FAN)
    groups = -(-members // GROUP)
    grouped = asks.withColumn("team", F.pmod(F.xxhash64("member"), F.lit(groups)).cast("long"))

    def merge(table):
        order, team = table["order"][0].as_py(), table["team"][0].as_py()
        every, total, _ = _sum([_unpack_sorted(x) for x in table["keys"].to_pylist()], [_unpack(x) for x in table["counts"].to_pylist()])
        return _table(_ASK, list(_asks(every, total, team, order, done, step)))

    finer, leaf = _resolve(grouped.groupBy("slice", "order", "team").applyInArrow(merge, _ASK), groups, done + step, bits - step)
    finer = finer.select(F.shiftright("slice", step).alias("slice"), "order", F.col("member").alias("team"), F.col("slice").alias("finer"), F.col("counts").alias("totals"))

    def hand_down(asked, told):
        if not asked.num_rows:
            return _table(_REPLY, [])
        keys = [_unpack_sorted(x) for x in asked["keys"].to_pylist()]
        every = _distinct(np.concatenate(keys))[0]
        total = np.concatenate([_unpack(c) for _, c in sorted(zip(told["finer"].to_pylist(), told["totals"].to_pylist()))])
        rows = zip(asked["member"].to_pylist(), asked["order"].to_pylist(), asked["slice"].to_pylist(), keys)
        return _table(_REPLY, [(m, o, s, _pack(total[np.searchsorted(every, k)]), 0, 0, 0, 0) for m, o, s, k in rows])

    by = ["slice", "order", "team"]
    replies = materialize(grouped.groupBy(*by).cogroup(finer.groupBy(*by)).applyInArrow(hand_down, _REPLY), "replies")
    discard(asks)
    return replies, leaf


class Automaton:
    """The part of the model that a block's texts can reach. counts: per order the training counts of the distinct n-grams, in the order of their keys."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray, order: int, counts: list[np.ndarray], n_texts: int, n_train: int, kinds: int, discount: float, mu: list[float]):
        start = np.cumsum(sizes) - sizes
        first = np.zeros(len(codes), bool)
        first[start] = True
        grams = ngrams(vocabulary, codes, sizes, order)
        _, _, rep, self.word = next(grams)
        c = counts[0]
        known = c > 0
        self.order, self.words = order, len(rep)
        self.known, self.count = known, c
        p = np.where(known, c - discount, discount * kinds) / n_train  # the probability that the lower order gives to each n-gram's last word
        self.root_weight = np.log10(p)
        # State 0 is the root, 1 the begin mark; then the contexts of one word, of two words and so on.
        state = np.where(known, np.cumsum(known) + 1, 0)
        self.root_target = state
        fail, fail_weight = [np.zeros(2 + known.sum(), np.int64)], [np.array([0.0]), np.log10(mu[0] / (np.array([float(n_texts), *c[known]]) + mu[0]))]
        n_states = 2 + int(known.sum())
        context, context_count, lower = np.where(known, state, 0)[self.word], c[self.word], self.word  # of the (n-1)-gram that ends at each place
        arc_key, arc_weight, arc_target = [], [], []
        for n in range(2, order + 1):
            at, _, rep, number = next(grams)
            c = counts[n - 1]
            seen = c > 0
            # The context of each n-gram ends one place before it; a text's first place has the begin mark's.
            begins = first[rep] if n == 2 else np.zeros(len(rep), bool)
            source = np.where(begins, 1, context[rep - 1])
            total = np.where(begins, float(n_texts), context_count[rep - 1])
            p = (c + mu[n - 2] * p[lower[rep]]) / (total + mu[n - 2])
            if n < order:
                state = np.where(seen, n_states + np.cumsum(seen) - 1, 0)
                fail.append(context[rep[seen]])
                fail_weight.append(np.log10(mu[n - 1] / (c[seen] + mu[n - 1])))
                target = state
                n_states += int(seen.sum())
            else:
                target = context[rep]
            arc_key.append(source[seen] * self.words + self.word[rep[seen]])
            arc_weight.append(np.log10(p[seen]))
            arc_target.append(target[seen])
            if n < order:
                here, here_count, here_lower = np.zeros(len(codes), np.int64), np.zeros(len(codes)), np.zeros(len(codes), np.int64)
                here[at], here_count[at], here_lower[at] = state[number], c[number], number
                # Where no n-gram ends (a text's first places), no longer n-gram asks for it.
                context, context_count, lower = here, here_count, here_lower
        key = np.concatenate(arc_key)
        by = np.argsort(key)
        self.arc_key, self.arc_weight, self.arc_target = key[by], np.concatenate(arc_weight)[by], np.concatenate(arc_target)[by]
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after one word each, weights of the arcs taken)."""
        out, weight = np.empty(len(state), np.int64), np.zeros(len(state))
        todo, s, w = np.arange(len(state)), state, word
        while len(todo):
            at_root = s == 0
            if at_root.any():
                i, x = todo[at_root], w[at_root]
                out[i] = self.root_target[x]
                weight[i] += self.root_weight[x]
                todo, s, w = todo[~at_root], s[~at_root], w[~at_root]
            if not len(todo):
                break
            key = s * self.words + w
            by = np.argsort(key)  # neighbours are found in neighbouring memory
            todo, s, w, key = todo[by], s[by], w[by], key[by]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == key if len(self.arc_key) else np.zeros(len(key), bool)
            i, arc = todo[hit], arc[hit]
            out[i] = self.arc_target[arc]
            weight[i] += self.arc_weight[arc]
            todo, s, w = todo[~hit], s[~hit], w[~hit]
            weight[todo] += self.fail_weight[s]
            s = self.fail[s]
        return out, weight

    def walk(self, sizes: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """The log10 probability of each text."""
        start = np.cumsum(sizes) - sizes
        parts = -(-sizes // segment)
        text = np.repeat(np.arange(len(sizes)), parts)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * segment
        ahead = np.minimum(begin, self.order - 1)
        length = np.minimum(sizes[text] - begin, segment) + ahead
        by = np.argsort(-length, kind="stable")
        text, ahead, length, at = text[by], ahead[by], length[by], (start[text] + begin - ahead)[by]
        state = np.where(begin[by] == ahead, 1, 0)
        total = np.zeros(len(text))
        live = len(text)
        for t in range(int(length[0]) if len(length) else 0):
            while live and length[live - 1] <= t:
                live -= 1
            state, weight = self.step(state[:live], self.word[at[:live] + t])
            total[:live] += np.where(t >= ahead[:live], weight, 0.0)
        return np.bincount(text, weights=total, minlength=len(sizes))


def score_corpus(docs: DataFrame, *, doc_id="doc_id", text="text", held_out=None, order=3, mu=(50.0, 5.0), block_bytes=6 << 20, slice_keys=1 << 21) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a boolean column of docs' own
    columns; its rows teach nothing. mu: the weight of the lower order, from order 2 on (the last one for all above)."""
    mu = [float(mu[min(n, len(mu) - 1)]) for n in range(order - 1)]
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held"))
    id_type = rows.schema["doc"].dataType
    kept = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("n_train", T.LongType()), T.StructField("docs", T.ArrayType(id_type)), T.StructField("held", T.ArrayType(T.BooleanType())), *(T.StructField(n, T.BinaryType()) for n in ("sizes", "vocabulary", "codes"))])

    def to_blocks(batches):
        from pyspark import TaskContext

        number, held, size, words = TaskContext.get().partitionId() << 36, [], 0, _Numbers()

        def block():
            nonlocal number, held, size, words
            number += 1
            sizes = np.fromiter((len(x) for _, _, x in held), np.int64, len(held))
            row = (number, int(sizes.sum()), sum(not h for _, h, _ in held), [d for d, _, _ in held], [h for _, h, _ in held], _pack(sizes), word_hashes(words).tobytes(), _pack(np.concatenate([x for _, _, x in held])))
            held, size, words = [], 0, _Numbers()
            return _table(kept, [row]).to_batches()

        for batch in batches:
            for d, t, h in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["held"].to_pylist()):
                x = numbered(t, words)
                held.append((d, h, x))
                size += 6 * len(x)
                if size >= block_bytes:
                    yield from block()
        if held:
            yield from block()

    blocks = materialize(rows.mapInArrow(to_blocks, kept), "blocks")
    n_blocks, total, n_texts = (int(x or 0) for x in blocks.agg(F.count(F.lit(1)), F.sum("n"), F.sum("n_train")).first())
    bits = max(4, (total // slice_keys).bit_length())
    first = min(bits, FAN)

    def unpacked(row):
        return np.frombuffer(row["vocabulary"], np.uint64), _unpack(row["codes"]).astype(np.int64), _unpack(row["sizes"]).astype(np.int64), np.array(row["held"], bool)

    def requests(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vocabulary, codes, sizes, held = unpacked(row)
                train = np.repeat(~held, sizes)
                for n, (at, every, _, number) in enumerate(ngrams(vocabulary, codes, sizes, order), 1):
                    count = np.bincount(number, weights=train[at], minlength=len(every)).astype(np.uint64)
                    yield from _table(_ASK, list(_asks(every, count, row["block"], n, 0, first))).to_batches()

    replies, leaf = _resolve(blocks.select("block", "held", "sizes", "vocabulary", "codes").mapInArrow(requests, _ASK), n_blocks, first, bits - first)
    n_train, kinds, once, twice = (int(x or 0) for x in leaf.filter("order = 1").agg(*(F.sum(n) for n in ("tokens", "kinds", "once", "twice"))).first())
    discount = once / (once + 2 * twice) if once else 0.5
    out = T.StructType([T.StructField("doc", id_type), T.StructField("held", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def traverse(block, told):
        if not block.num_rows:
            return _table(out, [])
        row = block.to_pylist()[0]
        vocabulary, codes, sizes, held = unpacked(row)
        by: dict[int, list] = {n: [] for n in range(1, order + 1)}
        for n, _, c in sorted(zip(told["order"].to_pylist(), told["slice"].to_pylist(), told["counts"].to_pylist())):
            by[n].append(_unpack(c).astype(np.float64))
        counts = [np.concatenate(by[n]) if by[n] else np.zeros(0) for n in by]
        add = lambda x: np.add.reduceat(x, np.cumsum(sizes) - sizes)
        if n_train:
            machine = Automaton(vocabulary, codes, sizes, order, counts, n_texts, n_train, kinds, discount, mu)
            c, word, score = machine.count, machine.word, machine.walk(sizes)
        else:
            c, word, score = counts[0], next(ngrams(vocabulary, codes, sizes, 1))[3], np.zeros(len(sizes))
        base = np.log10((c + 1) / (n_train + 1 * (kinds + 1)))
        return _table(out, list(zip(row["docs"], held.tolist(), sizes.tolist(), add((c > 0).astype(np.int64)[word]).tolist(), add(base[word]).tolist(), score.tolist())))

    told = replies.select(F.col("member").alias("block"), "order", "slice", "counts")
    scored = blocks.drop("n", "n_train").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(traverse, out)
    return scored.select(F.col("doc").alias(doc_id), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
