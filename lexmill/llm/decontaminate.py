"""Benchmark decontamination: an FM-index per shard of the corpus, searched for benchmark windows.

A task turns its documents, shard by shard, into word codes: words of the benchmark have a code, any
other word is a separator. Runs between separators that are shorter than the shortest window cannot hold
an occurrence and are left out. Over what remains the shard gets a suffix array (prefix doubling),
its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All distinct windows are
searched backward at once by rank queries; occurrences are located by walking to the next sample, and
marked in their documents; marked words are merged into removal spans.

The benchmark travels to the tasks in blocks of at most `block_bytes` of text (an item beyond that is cut, with its windows
kept), each as a compact index of arrays that the driver builds once: hashed words, the text as word numbers, the distinct
windows' places and their items. One pass over the documents meets all blocks: a task holds one block at a time, marks what all of
them find, cuts, and searches again until none finds any. Nothing is shuffled. Words are compared by 64-bit hashes.

Defined cases: null, empty and wordless texts have no words, hits or spans; items without words have no
window. Repeated items are items of their own; repeated documents get a result each. An empty benchmark
leaves every document clean. Documents are joined to shards of about `shard_bytes`; a longer one is a shard of its own and is
searched whole. Extra columns are kept, but for those of the result's names (n_words, hit_spans, hit_items), which are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import task_batches

#: Words consist of ASCII letters and digits (A-Z in lower case) and of all bytes beyond ASCII.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class _Hashes(dict):
    def __missing__(self, w):
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASH = _Hashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))


class Windows:
    """The distinct windows of some items, as arrays: the sorted hashes of their words (code: place + 1), all items' codes in a row, where each
    window begins and its length, and the items of each window (window i: items[at[i]:at[i + 1]] as numbers of `ids`)."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.ids = [i for i, _ in items]
        texts = [hashed(words_of(t)) for _, t in items]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        self.vocabulary, codes = np.unique(flat, return_inverse=True)
        self.codes = (codes + 1).astype(np.int32)
        count = np.where(sizes > 0, np.maximum(sizes - width + 1, 1), 0)
        item = np.repeat(np.arange(len(texts)), count)
        begin = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(count) - count), count) + np.arange(count.sum())
        length = np.minimum(sizes, width)[item]
        # Equal windows stand together under a hash of their codes; neighbours are then compared code by code.
        h = length.astype(np.uint64)
        padded = np.concatenate((self.codes, np.zeros(width, np.int32)))
        for j in range(width):
            c = np.where(j < length, padded[begin + j], 0).astype(np.uint64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c
        order = np.lexsort((item, h))
        begin, length, item = begin[order], length[order], item[order]
        new = np.ones(len(order), bool)
        if len(order):
            same = length[1:] == length[:-1]
            for j in range(width):
                same &= (padded[begin[1:] + j] == padded[begin[:-1] + j]) | (j >= length[1:])
            new[1:] = ~same
        first = np.flatnonzero(new)
        self.begin, self.length = begin[first].astype(np.int32), length[first].astype(np.int32)
        again = np.zeros(len(item), bool)  # a window that an item holds twice counts once
        again[1:] = ~new[1:] & (item[1:] == item[:-1])
        self.items = item[~again].astype(np.int32)
        self.at = np.concatenate((np.cumsum(~again)[first] - 1, [len(self.items)])).astype(np.int64) if len(first) else np.zeros(1, np.int64)
        self.shortest = int(self.length.min()) if len(first) else 0

    def codes_of(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words; 0: no word of the items."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


class FMIndex:
    """Of a code sequence in which 0 separates; no pattern holds a 0."""

    SAMPLE = 8

    def __init__(self, seq: np.ndarray):
        self.n = n = len(seq)
        self.top = int(seq.max())
        zeros = np.flatnonzero(seq == 0)
        # Separators sort by place, so no common prefix reaches beyond one and doubling ends at the longest run.
        rank = seq.astype(np.int64) + len(zeros)
        rank[zeros] = np.arange(len(zeros))
        sa, step = np.argsort(rank, kind="stable"), 1
        rank = self._ranks(rank[sa], sa)
        while rank[sa[-1]] < n - 1:
            nxt = np.full(n, -1, np.int64)
            nxt[:-step] = rank[step:]
            key = rank * (n + 1) + nxt + 1
            sa = np.argsort(key, kind="stable")
            rank = self._ranks(key[sa], sa)
            step *= 2
        bwt = seq[sa - 1]  # before position 0 stands the last symbol, a separator
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=int(seq.max()) + 2))))
        self.levels = []
        level, bits = bwt, max(1, int(seq.max()).bit_length())
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
            self.levels.append((b, ones, n - int(ones[-1])))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.bwt = bwt
        kept = (sa % self.SAMPLE == 0) | (bwt == 0)  # a walk never has to cross a separator
        self.kept, self.sampled = np.concatenate(([0], np.cumsum(kept))), sa[kept]
        self.is_kept = kept

    @staticmethod
    def _ranks(keys, sa):
        rank = np.empty(len(sa), np.int64)
        rank[sa] = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
        return rank

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before i in the transform, by the wavelet matrix."""
        lo = np.zeros_like(i)
        for b, ones, zeros in self.levels:
            bit = (c >> b) & 1
            lo1, i1 = ones[lo], ones[i]
            lo, i = np.where(bit, zeros + lo1, lo - lo1), np.where(bit, zeros + i1, i - i1)
        return i - lo

    def search(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [lo, hi) of the suffixes that start with codes[begin : begin + length], for each pattern."""
        lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), self.n, np.int64)
        here = np.zeros(max(self.top, int(codes.max(initial=0))) + 1, bool)
        here[: self.top + 1] = np.diff(self.first[: self.top + 2]) > 0
        # A pattern whose first or last word the text lacks ends at once.
        dead = ~(here[codes[begin]] & here[codes[begin + length - 1]])
        hi[dead] = 0
        live, j = np.flatnonzero(~dead), 1
        while len(live):
            c = codes[begin[live] + length[live] - j].astype(np.int64)
            inside = here[c]
            lo[live[~inside]] = hi[live[~inside]] = 0
            live, c = live[inside], c[inside]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
            live, j = live[hi[live] > lo[live]], j + 1
            live = live[length[live] >= j]
        return lo, np.maximum(hi, lo)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: step back until a sample."""
        out, steps, todo = np.empty(len(at), np.int64), 0, np.arange(len(at))
        at = at.copy()
        while len(todo):
            hit = self.is_kept[at]
            out[todo[hit]] = self.sampled[self.kept[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt[at].astype(np.int64)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out


CHUNK = 1 << 18  # windows that are searched at once
FEW_WORDS = 200_000


def shard_hits(words: np.ndarray, n_words: np.ndarray, win: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents given by their words' hashes in a row and their numbers of words: per occurrence the document, its first word and the window."""
    none = np.empty(0, np.int64)
    if not win.shortest or not len(words):
        return none, none, none
    starts = np.concatenate(([0], np.cumsum(n_words + 1)))
    seq = np.zeros(starts[-1] + 1, np.int32)
    seq[np.arange(len(words)) + np.repeat(np.arange(len(n_words)), n_words)] = win.codes_of(words)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (seq > 0).astype(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    fit = end - begin >= win.shortest
    begin, end = begin[fit], end[fit]
    if not len(begin):
        return none, none, none
    sizes = end - begin + 1  # with a separator behind each run
    at = np.concatenate(([0], np.cumsum(sizes)))
    place = np.repeat(begin - at[:-1], sizes) + np.arange(at[-1])
    small = seq[place]
    small[at[1:] - 1] = 0
    index = FMIndex(small)
    found_at, found_win = [none], [none]
    for k in range(0, len(win.begin), CHUNK):
        lo, hi = index.search(win.codes, win.begin[k : k + CHUNK].astype(np.int64), win.length[k : k + CHUNK].astype(np.int64))
        count = hi - lo
        hit = count > 0
        if hit.any():
            total = np.repeat(lo[hit], count[hit]) + np.arange(count[hit].sum()) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            found_at.append(place[index.locate(total)])
            found_win.append(np.repeat(np.flatnonzero(hit) + k, count[hit]))
    pos, num = np.concatenate(found_at), np.concatenate(found_win)
    doc = np.searchsorted(starts, pos, side="right") - 1
    return doc, pos - starts[doc], num


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap become one; sorted by document and place."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # With an offset for each document one running maximum does for all.
    step = int(end.max()) + 2
    far = np.maximum.accumulate(doc * step + end)
    new = np.concatenate(([True], doc[1:] * step + start[1:] > far[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return doc[first], start[first], far[last] - doc[first] * step


class Blocks:
    """The benchmark's blocks as broadcasts of Windows; a task holds one at a time, or all while they are small together. words: the hashes of
    all items' words while these are few, so that other words need no hash (they get 0); else None."""

    def __init__(self, sent: list, keep: bool, words: dict[bytes, int] | None = None):
        self.sent, self.keep, self.words = sent, keep, words

    def __iter__(self):
        for b in self.sent:
            yield b.value
            if not self.keep:
                b.__dict__.pop("_value", None)  # read again from the executor's copy when its turn comes


def _pieces(item, text: str | None, most: int, width: int):
    """An item, or an item's parts of at most `most` bytes that share width - 1 words, so each window lies in one whole."""
    if not text or len(text) <= most // 4 or len(text.encode("utf-8", "surrogatepass")) <= most:
        yield item, text
        return
    words = words_of(text)
    at, size, lo = 0, 0, 0
    for k, w in enumerate(words):
        size += len(w) + 1
        if size > most and k - lo >= width:
            yield item, b" ".join(words[lo:k]).decode("utf-8", "surrogatepass")
            lo, size = k - width + 1, sum(map(len, words[k - width + 1 : k + 1]))
        at = k
    yield item, b" ".join(words[lo : at + 1]).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int, width: int) -> Blocks:
    """Blocks of at most block_bytes of text (an item's last width words may exceed it); the driver reads the items one partition at a time and holds one block."""
    sc = benchmark.sparkSession.sparkContext
    sent, held, size, total, known = [], [], 0, 0, {}

    def send():
        nonlocal held, size, known
        if known is not None:
            for _, t in held:
                known.update((w, _HASH[w]) for w in words_of(t))
            known = known if len(known) <= FEW_WORDS else None
        sent.append(sc.broadcast(Windows(held, width)))
        sent[-1].__dict__.pop("_value", None)
        held, size = [], 0

    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        for item, part in _pieces(row.i, row.t, block_bytes, width):
            n = len((part or "").encode("utf-8", "surrogatepass")) + 16
            if held and size + n > block_bytes:
                send()
            held.append((item, part))
            size, total = size + n, total + n
    if held:
        send()
    return Blocks(sent, total <= 2 * block_bytes, known)


def _word_hashes(texts: list[str | None], known: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    if known is None:
        parts = [hashed(words_of(t)) for t in texts]
    else:
        split = map(words_of, texts)
        parts = [np.fromiter(map(known.get, ws, repeat(0)), np.uint64, len(ws)) for ws in split]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.fromiter(map(len, parts), np.int64, len(parts))


def _hits_of_all(texts: list[str | None], blocks) -> tuple[np.ndarray, tuple, list[tuple[np.ndarray, list]]]:
    """(words per text, merged spans over all blocks, per block the distinct (text, item number) pairs and the items' ids)."""
    words, n_words = _word_hashes(texts, blocks.words)
    doc, start, end, items = [], [], [], []
    for win in blocks:
        d, at, num = shard_hits(words, n_words, win)
        d1, s1, e1 = merged_spans(d, at, at + win.length[num])
        doc, start, end = [*doc, d1], [*start, s1], [*end, e1]
        if len(d):
            pair = np.unique(d * np.int64(len(win.begin)) + num)  # each window of a text once, however often it stands there
            d, num = pair // len(win.begin), pair % len(win.begin)
            n = win.at[num + 1] - win.at[num]
            item = win.items[np.repeat(win.at[num] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            items.append((np.unique(np.repeat(d, n) * np.int64(len(win.ids)) + item), win.ids))
    none = [np.empty(0, np.int64)]
    return n_words, merged_spans(*(np.concatenate(none + x) for x in (doc, start, end))), items


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text="text", item_id="item_id", item_text="text", width=10, block_bytes=32 << 20, shard_bytes=12 << 20) -> DataFrame:
    """docs with n_words (long), hit_spans (merged word ranges, end exclusive) and hit_items (sorted distinct ids; the windows of an item without an
    id are hit, but it is not listed)."""
    item_type = T.LongType() if dict(benchmark.dtypes)[item_id] != "string" else T.StringType()
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("hit_items", T.ArrayType(item_type))])
    blocks = _blocks(benchmark, item_id, item_text, block_bytes, width)

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for table in task_batches(batches, None, 1 << 13, shard_bytes):
            n_words, (doc, start, end), found = _hits_of_all(table[text].to_pylist(), blocks)
            n = table.num_rows
            edges = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], fields=list(span)))
            items_of: list = [()] * n
            for pairs, ids in found:
                at = np.concatenate(([0], np.cumsum(np.bincount(pairs // len(ids), minlength=n))))
                for d in np.unique(pairs // len(ids)):
                    items_of[d] = {*items_of[d], *(ids[i] for i in pairs[at[d] : at[d + 1]] % len(ids))}
            items = pa.array([sorted(i for i in x if i is not None) for x in items_of], pa.list_(pa.int64() if item_type == T.LongType() else pa.string()))
            for name, column in (("n_words", pa.array(n_words)), ("hit_spans", spans), ("hit_items", items)):
                table = table.append_column(name, column)
            yield from table.to_batches()

    return docs.mapInArrow(run, schema)


def cut_spans(text: str, spans) -> str:
    """text without the words of spans and what stands between them; a newline marks each cut."""
    data = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(data.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    begin, end, at, out = edge[::2], edge[1::2], 0, []
    for s in spans:
        out.append(data[at : begin[s["start"]]])
        at = int(end[s["end"] - 1])
    return b"\n".join([*(x.rstrip() for x in out), data[at:].lstrip()]).strip(b"\n").decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text="text", n_chars="n_chars", item_id="item_id", item_text="text", width=10, block_bytes=32 << 20, shard_bytes=12 << 20) -> DataFrame:
    """docs without benchmark passages: what any block marks is cut until no block finds a window (a cut can join what
    stood around it; each round removes words, so it ends); texts left without a word go. n_chars, if there, follows the text."""
    blocks = _blocks(benchmark, item_id, item_text, block_bytes, width)

    def run(batches):
        import pyarrow as pa

        for table in task_batches(batches, None, 1 << 13, shard_bytes):
            texts, keep = table[text].to_pylist(), np.ones(table.num_rows, bool)
            todo, changed = list(range(len(texts))), set()
            while todo:
                _, (doc, start, end), _ = _hits_of_all([texts[i] for i in todo], blocks)
                spans: dict[int, list[dict]] = {}
                for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()):
                    spans.setdefault(todo[d], []).append({"start": a, "end": b})
                for i, cut in spans.items():
                    texts[i] = cut_spans(texts[i], cut)
                todo = sorted(spans)
                changed.update(todo)
            if changed:
                for i in changed:
                    keep[i] = bool(words_of(texts[i]))
                put = lambda t, c, v: t.set_column(t.column_names.index(c), t.schema.field(c), pa.array(v, t.schema.field(c).type))
                table = put(table, text, texts)
                if n_chars in table.column_names:
                    n = table[n_chars].to_pylist()
                    for i in changed:
                        n[i] = len(texts[i])
                    table = put(table, n_chars, n)
                table = table.filter(pa.array(keep))
            yield from table.to_batches()

    return docs.mapInArrow(run, docs.schema)


def contamination_digest(found: DataFrame, doc_id="doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated, from find_contamination()."""
    n_hit = F.expr("aggregate(hit_spans, 0L, (a, s) -> a + s.end - s.start)")
    ids = F.array_join(F.array_sort(F.col("hit_items").cast("array<string>")), ",")
    return found.select(doc_id, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def brute_force(texts: list[str | None], items: list[tuple[int, str | None]], width: int = 10) -> list[tuple[int, int, list[int]]]:
    """For tests: (n_words, n_hit, items) by comparing every window with every place."""
    out = []
    for t in texts:
        ws, hit, ids = words_of(t), set(), set()
        for item, it in items:
            iw = words_of(it)
            for j in range(max(1, len(iw) - width + 1) if iw else 0):
                w = iw[j : j + width]
                for i in range(len(ws) - len(w) + 1):
                    if ws[i : i + len(w)] == w:
                        hit.update(range(i, i + len(w)))
                        ids.add(item)
        out.append((len(ws), len(hit), sorted(ids)))
    return out


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
