"""Substring deduplication by fixed-block anchors.

Of each document, the non-overlapping blocks of `window` // 2 words (at words 0, 25, 50, ...) are the reference; every rolling window of that length
probes them. A stretch of `window` words holds a whole block wherever it lies, so two equal stretches always share an anchor: a block
of one that a rolling window of the other meets. Hits are then extended on both sides: each stretch of `window` words around an
anchor gets a name, the earliest document of each name is found, and the stretches that an earlier document holds
are removed; neighbouring ones join to maximal exact repeats. Stretches are never compared pair by pair, so a passage in very many documents
costs each of them its own words only.

Documents are gathered into blocks of about `block_bytes` of text, written once. A block sends its distinct probes, sorted and cut in
slices of the hash range; a slice joins the reference with the probes and answers each block with its anchors. Names of the stretches
around anchors go the same way and come back with a smaller document id where there is one. A block sends at most 2^FAN slices;
where slices must be finer, groups of blocks are merged per slice and ask further as blocks do. So what is shuffled grows with
the corpus, a task's memory with the block (or one longer text) and the slice.

Anchors are short hashes: a chance collision only makes one more stretch be named. Names have 96 bits, made of 128-bit word hashes
(10^13 different named stretches share a name with probability 0.001).

Defined cases: words are split at ASCII white space and compared as they are. A null or empty text has no words. A document of fewer than `window` words
loses none. Of rows that are equal in doc_id none is earlier; a null doc_id is earlier than none and loses nothing. An empty table gives no row.
doc_id is an integer column. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .langmodel import _Numbers, _pack, _pack_sorted, _table, _unpack, _unpack_sorted

WINDOW = 50
FAN = 12  # bits of a hash by which one level of asking is cut
GROUP = 64  # blocks that are merged where slices must be finer
WORD_BYTES = 6  # of a word and the space behind it, about: from this the number of words is judged
SPARE = 8  # bits of an anchor's hash beyond those that number all words

_ASK = T.StructType([T.StructField("slice", T.LongType()), T.StructField("member", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("high", "low", "value"))])
_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("sizes", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("texts", T.BinaryType())])
_OUT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType())])

Names = tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted (high, low), and a value each


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * seed)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, lengths: list[int], seed: int) -> list[np.ndarray]:
    """Hashes of all stretches of each length (increasing); stretches of powers of two are joined to those of the wanted lengths."""
    join = lambda a, b: _mix(a * np.uint64(0x9E3779B97F4A7C15) + b, seed)
    powers, size = [_mix(words, seed)], 1
    while 2 * size <= lengths[-1]:
        last = powers[-1]
        powers.append(join(last[:-size], last[size:]) if len(last) > size else last[:0])
        size *= 2
    out = []
    for n in lengths:
        most = max(0, len(words) - n + 1)
        at, made = 0, None
        for k in reversed(range(n.bit_length())):
            if n >> k & 1:
                part = powers[k][at : at + most] if most else powers[k][:0]
                made = part if made is None else join(made, part)
                at += 1 << k
        out.append(made)
    return out


class Words:
    """The words of a block's texts: per word its text, its place there and how many words follow in the text, itself included."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        numbers, self.texts, codes = _Numbers(), [t.split() for t in texts], []
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(texts))
        for ws in self.texts:
            codes.append(np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws)))
        codes = np.concatenate([*codes, np.zeros(0, np.int64)])
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), "<u8").reshape(-1, 2)
        self.high, self.low = digest[codes, 0], digest[codes, 1]
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.left = self.sizes[self.text] - self.place

    def starts(self, n: int) -> np.ndarray:
        """Words at which a stretch of n words of one text starts."""
        return np.flatnonzero(self.left >= n)


def grouped(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order of the names, the places in it at which another name begins)."""
    by = np.argsort(high)
    same = high[by[1:]] == high[by[:-1]]
    other = low[by[1:]] != low[by[:-1]]
    if (same & other).any():  # high parts clash: rare
        by = np.lexsort((low, high))
        same, other = high[by[1:]] == high[by[:-1]], low[by[1:]] != low[by[:-1]]
    new = np.ones(len(by), bool)
    new[1:] = ~same | other
    return by, np.flatnonzero(new)


def combine(high: np.ndarray, low: np.ndarray, value: np.ndarray, how) -> Names:
    """Distinct names and the values of each, put together by how (a ufunc)."""
    by, at = grouped(high, low)
    return high[by[at]], low[by[at]], how.reduceat(value[by], at) if len(at) else value


def find(names: Names, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the asked that stand among the names, the place of each there). Names that share their high part are searched one by one."""
    if not len(names[0]) or not len(high):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, asked = np.searchsorted(names[0], high), np.arange(len(high))
    found, place = [], []
    while len(asked):
        inside = at < len(names[0])
        at, asked = at[inside], asked[inside]
        same = names[0][at] == high[asked]
        at, asked = at[same], asked[same]
        hit = names[1][at] == low[asked]
        found.append(asked[hit])
        place.append(at[hit])
        at, asked = at[~hit] + 1, asked[~hit]
    return np.concatenate(found), np.concatenate(place)


def _row(slice_: int, member: int, names: Names) -> tuple:
    return slice_, member, _pack_sorted(names[0]), _pack(names[1]), _pack(names[2])


def _asks(names: Names, member: int, width: int, done: int, bits: int):
    """Rows of _ASK for names of `width` high bits that agree in the first `done`, in slices by the next `bits`."""
    high = names[0]
    if not len(high):
        return
    rest = width - done - bits
    number = high >> np.uint64(rest)
    cut = [0, *np.flatnonzero(number[1:] != number[:-1]) + 1, len(high)]
    for a, b in zip(cut, cut[1:]):
        yield _row(int(number[a]), member, tuple(x[a:b] for x in names))


def _read(high, low, value) -> Names:
    return _unpack_sorted(high), _unpack(low), _unpack(value)


class Anchors:
    """Values 0 to 3: a block of the reference (1) that is probed from another place, too (2). The answer holds those that are both."""

    @staticmethod
    def merge(parts: list[Names]) -> Names:
        high, low, value = (np.concatenate(x) for x in zip(*parts))
        some = combine(high, low, value, np.bitwise_or)
        often = combine(high, low, np.ones(len(high), np.uint64), np.add)[2] > 1
        return some[0], some[1], some[2] | (often.astype(np.uint64) << np.uint64(1))

    @staticmethod
    def answer(asked: Names, merged: Names) -> Names:
        i, at = find(merged, asked[0], asked[1])
        i, at = i[by := np.argsort(i)], at[by]
        hit = merged[2][at] == 3
        return asked[0][i[hit]], asked[1][i[hit]], merged[2][at[hit]]


class Earliest:
    """Values: numbers of documents. The answer holds names that an earlier document has, with its number."""

    @staticmethod
    def merge(parts: list[Names]) -> Names:
        return combine(*(np.concatenate(x) for x in zip(*parts)), np.minimum)

    @staticmethod
    def answer(asked: Names, merged: Names) -> Names:
        i, at = find(merged, asked[0], asked[1])
        i, at = i[by := np.argsort(i)], at[by]
        less = merged[2][at] < asked[2][i]
        return asked[0][i[less]], asked[1][i[less]], merged[2][at[less]]


def _resolve(asks: DataFrame, members: int, kind, width: int, done: int, bits: int) -> DataFrame:
    """The answers (_ASK) to all members. The asks are cut by `done` bits, `bits` more are needed."""

    def parts(table) -> list[Names]:
        return [_read(*x) for x in zip(*(table[c].to_pylist() for c in ("high", "low", "value")))]

    def answers(table, merged: Names, asked: list[Names]):
        told = [kind.answer(a, merged) for a in asked]
        return _table(_ASK, [_row(s, m, t) for s, m, t in zip(table["slice"].to_pylist(), table["member"].to_pylist(), told) if len(t[0])])

    if bits <= 0:

        def settle(table):
            asked = parts(table)
            return answers(table, kind.merge(asked), asked)

        return asks.groupBy("slice").applyInArrow(settle, _ASK)

    asks, step = materialize(asks, "asks"), min(bits, FAN)
    groups = -(-members // GROUP)
    grouped = asks.withColumn("team", F.pmod(F.xxhash64("member"), F.lit(groups)).cast("long"))

    def merge(table):
        return _table(_ASK, list(_asks(kind.merge(parts(table)), table["team"][0].as_py(), width, done, step)))

    finer = _resolve(grouped.groupBy("slice", "team").applyInArrow(merge, _ASK), groups, kind, width, done + step, bits - step)
    finer = finer.select(F.shiftright("slice", step).alias("slice"), F.col("member").alias("team"), "high", "low", "value")

    def hand_down(asked, told):
        if not asked.num_rows:
            return _table(_ASK, [])
        # What the members of a team know of each other wasn't told to the team.
        own = parts(asked)
        return answers(asked, kind.merge(own + parts(told)), own)

    return grouped.groupBy("slice", "team").cogroup(finer.groupBy("slice", "team")).applyInArrow(hand_down, _ASK)


def _blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, ids, held, size = TaskContext.get().partitionId() << 36, [], [], 0

        def block():
            nonlocal number, ids, held, size
            number += 1
            joined = b"".join(held)
            row = (number, ids, _pack(np.fromiter(map(len, held), np.uint64, len(held))), len(joined), pa.compress(joined, "zstd", asbytes=True))
            ids, held, size = [], [], 0
            return _table(_BLOCK, [row]).to_batches()

        for batch in batches:
            for d, t in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
                ids.append(d)
                held.append(t or b"")
                size += len(held[-1]) + 64
                if size >= block_bytes:
                    yield from block()
        if held:
            yield from block()

    return materialize(rows.mapInArrow(run, _BLOCK), "blocks")


def _texts(row: dict) -> list[bytes]:
    import pyarrow as pa

    joined = pa.decompress(row["texts"], row["n_bytes"], "zstd", asbytes=True) if row["n_bytes"] else b""
    end = np.cumsum(_unpack(row["sizes"]).astype(np.int64)).tolist()
    return [joined[a:b] for a, b in zip([0, *end], end)]


def find_repeats(docs: DataFrame, *, doc_id="doc_id", text="text", window=WINDOW, block_bytes=6 << 20, slice_keys=1 << 21) -> DataFrame:
    """doc_id, n_words, removed (spans of words, ends excluded, in order), kept (the words left, joined by one space)."""
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{doc_id} has to be an integer column")
    if window < 2:
        raise ValueError("a window has two words at least")
    half = window // 2
    blocks = _blocks(docs, doc_id, text, block_bytes)
    members, size, least = blocks.agg(F.count(F.lit(1)), F.sum("n_bytes"), F.min(F.array_min("docs"))).first()
    total, least = int(size or 0) // WORD_BYTES, int(least or 0)
    width = min(64, max(16, total.bit_length() + SPARE))
    cut = max(0, (total // slice_keys).bit_length())

    def probes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = Words(_texts(row))
                at = words.starts(half)
                key = rolling(words.high, [half], 0)[0][at] >> np.uint64(64 - width)
                names = Anchors.merge([(key, np.zeros(len(key), np.uint64), (words.place[at] % half == 0).astype(np.uint64))])
                yield from _table(_ASK, list(_asks(names, row["block"], width, 0, min(cut, FAN)))).to_batches()

    anchors = _resolve(blocks.select("block", "sizes", "n_bytes", "texts").mapInArrow(probes, _ASK), members, Anchors, width, min(cut, FAN), cut - min(cut, FAN))
    anchors = materialize(anchors, "anchors").select("slice", F.col("member").alias("block"), "high", "low", "value")

    def numbers(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Of a block's documents: numbers in the order of doc_id, and whether there is a doc_id."""
        known = np.array([d is not None for d in row["docs"]], bool)
        return np.fromiter(((d - least) if d is not None else (1 << 64) - 1 for d in row["docs"]), np.uint64, len(known)), known

    def names_of(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rolling(words.high, [window], 0)[0][at], rolling(words.low, [window], 1)[0][at] >> np.uint64(32)

    def stretches(block, told):
        if not block.num_rows or not told.num_rows:
            return _table(_ASK, [])
        row = block.to_pylist()[0]
        words = Words(_texts(row))
        found = np.sort(np.concatenate([_unpack_sorted(x) for x in told["high"].to_pylist()]))
        at = words.starts(half)
        key = rolling(words.high, [half], 0)[0][at] >> np.uint64(64 - width)
        is_anchor = np.zeros(len(words.text) + window + 1, np.int64)
        is_anchor[1 + at[found[np.minimum(np.searchsorted(found, key), len(found) - 1)] == key]] = 1
        seen = np.cumsum(is_anchor)  # anchors before each word
        at = words.starts(window)
        at = at[seen[at + window - half + 1] > seen[at]]
        names = combine(*names_of(words, at), numbers(row)[0][words.text[at]], np.minimum)
        return _table(_ASK, list(_asks(names, row["block"], 64, 0, min(cut, FAN))))

    columns = blocks.select("block", "docs", "sizes", "n_bytes", "texts")
    asked = columns.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(stretches, _ASK)
    earlier = _resolve(asked, members, Earliest, 64, min(cut, FAN), cut - min(cut, FAN))
    earlier = earlier.select("slice", F.col("member").alias("block"), "high", "low", "value")

    def remove(block, told):
        if not block.num_rows:
            return _table(_OUT, [])
        row = block.to_pylist()[0]
        words, (number, known) = Words(_texts(row)), numbers(row)
        at = words.starts(window)
        high, low = names_of(words, at)
        own = number[words.text[at]]
        told = combine(*(np.concatenate(x) for x in zip(*(_read(*x) for x in zip(*(told[c].to_pylist() for c in ("high", "low", "value")))))), np.minimum) if told.num_rows else (np.zeros(0, np.uint64),) * 3
        first = own.copy()
        if len(at):  # in the block itself
            by, new = grouped(high, low)
            first[by] = np.repeat(np.minimum.reduceat(own[by], new), np.diff(np.append(new, len(by))))
        i, place = find(told, high, low)  # in all others
        first[i] = np.minimum(first[i], told[2][place])
        edge = np.zeros(len(words.text) + 1, np.int64)
        gone = at[(first < own) & known[words.text[at]]]
        edge[gone] += 1
        np.subtract.at(edge, gone + window, 1)
        drop = np.cumsum(edge)[:-1] > 0
        # Spans end with their text.
        step = np.flatnonzero(drop & (np.concatenate(([True], ~drop[:-1])) | (words.place == 0))) if len(drop) else np.zeros(0, np.int64)
        last = np.flatnonzero(drop & (np.concatenate((~drop[1:], [True])) | (words.left == 1))) if len(drop) else step
        spans: dict[int, list] = {}
        for t, a, b in zip(words.text[step].tolist(), words.place[step].tolist(), words.place[last].tolist()):
            spans.setdefault(t, []).append({"start": a, "end": b + 1})
        rows = []
        for i, (d, ws) in enumerate(zip(row["docs"], words.texts)):
            cuts, left, at_word = spans.get(i, []), [], 0
            for s in cuts:
                left += ws[at_word : s["start"]]
                at_word = s["end"]
            rows.append((d, len(ws), cuts, b" ".join(left + ws[at_word:] if cuts else ws).decode("utf-8", "replace")))
        return _table(_OUT, rows)

    out = columns.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(remove, _OUT)
    return out.select(F.col("doc").cast(docs.schema[doc_id].dataType).alias(doc_id), "n_words", "removed", "kept")


def repeat_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(doc_id, "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
