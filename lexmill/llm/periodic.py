"""Periodic runs of words, found by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q and at least max(`least`, `times` * q) words that no neighbouring word extends
keeping period q. Texts of a batch are laid in a row and every stretch of 2^k words that stands more than once in its text gets a name (level k:
the pair of names of its halves); a stretch that stands once needs no name, so the levels thin out fast. How far the texts behind
two places agree (LCE) is found by going down the levels.

A run of period q with three periods holds two neighbouring multiples of q whose following words agree for a known least
length. So for each q only the multiples of q are looked at (n log n places of a text, level by level), most fall away at one comparison
of names, and of the multiples in one run only the first is kept. What is left is extended to both sides by LCE. A stretch that is also found
with a divisor of q has the smaller period and is one run.

All work is inside a row, so nothing is shuffled; a task holds one batch of about `batch_bytes`, or one longer text.

Defined cases: words are split at ASCII white space and compared as they are. A null or empty text has no words and no run. Repeated rows are
judged one by one. A null doc_id is kept. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import task_batches

LEAST, TIMES = 24, 3
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
PART = 1 << 21  # grid places looked at together


class Levels:
    """Names of the stretches of 1, 2, 4, ... words of texts laid in a row; -1 where a stretch stands once in its text or leaves it."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.end = np.repeat(np.cumsum(sizes), sizes)
        self.begin = self.end - np.repeat(sizes, sizes)
        self.names: list[np.ndarray] = []
        # A name belongs to one text.
        key, at = codes + (int(codes.max()) + 1 if len(codes) else 1) * np.repeat(np.arange(len(sizes)), sizes), np.arange(len(codes))
        while len(at):
            at, name = self._repeated(key, at)
            level = np.full(len(codes), -1, np.int32)
            level[at] = name
            self.names.append(level)
            half = 1 << (len(self.names) - 1)
            at = at[at + 2 * half <= self.end[at]]
            at = at[level[at + half] >= 0]
            key = level[at].astype(np.int64) << 32 | level[at + half]

    @staticmethod
    def _repeated(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose key stands more than once, and the number of that key."""
        order = np.argsort(key)
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        last = np.ones(len(k), bool)
        last[:-1] = new[1:]
        more = ~(new & last)
        return at[order[more]], (np.cumsum(new) - 1)[more].astype(np.int32)

    def same(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the 2^k words at a and at b (other places of the same texts) are equal."""
        if k >= len(self.names):
            return np.zeros(len(a), bool)
        x = self.names[k][a]
        return (x >= 0) & (x == self.names[k][b])

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words at a and at b > a agree, onwards."""
        n = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            fits = np.flatnonzero(b + n + (1 << k) <= self.end[a])
            fits = fits[self.same(k, a[fits] + n[fits], b[fits] + n[fits])]
            n[fits] += 1 << k
        return n

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b > a agree, backwards."""
        n = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            fits = np.flatnonzero(a - n - (1 << k) >= self.begin[a])
            fits = fits[self.same(k, a[fits] - n[fits] - (1 << k), b[fits] - n[fits] - (1 << k))]
            n[fits] += 1 << k
        return n


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of counts[i] rows for each i."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def runs_of(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period. sizes: words of each text; times: 3 or more."""
    sizes = np.asarray(sizes, np.int64)
    levels = Levels(codes, sizes)
    start = np.cumsum(sizes) - sizes
    held = [np.zeros((0, 3), np.int64)]
    longest = int(sizes.max(initial=0)) // times
    # From its first multiple of q on, the words of a run agree with those q words on for at least so long.
    q = np.arange(1, longest + 1)
    level = np.frexp(np.maximum(least, times * q) - 2 * q + 1)[1] - 1
    for k in np.unique(level):
        if k >= len(levels.names):
            continue
        text_of = np.unique(np.searchsorted(start + sizes, np.flatnonzero(levels.names[k] >= 0), side="right"))  # texts with a repeat that long
        low, high = int(q[level == k][0]), int(q[level == k][-1])
        # A period fits `times` times, and `least` words do.
        most = np.where(sizes[text_of] >= least, np.minimum(high, sizes[text_of] // times), 0)
        i, n = _ragged(np.maximum(0, most - low + 1))
        text, period = text_of[i], low + n
        places = sizes[text] // period
        done = 0
        for stop in [*np.flatnonzero(np.diff(np.cumsum(places) // PART)) + 1, len(places)]:
            owner, j = _ragged(places[done:stop])
            p = period[done:stop][owner]
            a = start[text[done:stop]][owner] + j * p
            ok = np.flatnonzero(a + p < levels.end[a]) if len(a) else np.zeros(0, np.int64)
            ok = ok[levels.same(int(k), a[ok], a[ok] + p[ok])]
            held.append(_extended(levels, a[ok], p[ok], least, times))
            done = stop
    found = np.concatenate(held)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):  # of equal stretches the smallest period
        found = found[np.concatenate(([True], (np.diff(found[:, :2], axis=0) != 0).any(axis=1)))]
    text = np.searchsorted(start + sizes, found[:, 0], side="right")
    by = np.lexsort((found[:, 2], found[:, 0]))
    found, text = found[by], text[by]
    return text, found[:, 0] - start[text], found[:, 1], found[:, 2]


def _extended(levels: Levels, a: np.ndarray, p: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) of the runs that hold the places a and a + p. A place that its run's last multiple of p precedes is passed over."""
    k = np.frexp(p)[1] - 1  # 2^k <= p: two stretches of 2^k words cover p words
    first = np.ones(len(a), bool)
    for level in np.unique(k):
        i = np.flatnonzero((k == level) & (a - p >= levels.begin[a]))
        covered = levels.same(int(level), a[i] - p[i], a[i]) & levels.same(int(level), a[i] - (1 << level), a[i] + p[i] - (1 << level))
        first[i[covered]] = False
    a, p = a[first], p[first]
    back = levels.behind(a, a + p)
    length = back + levels.ahead(a, a + p) + p
    good = length >= np.maximum(least, times * p)
    return np.stack((a[good] - back[good], length[good], p[good]), axis=1)


def find_runs(docs: DataFrame, *, doc_id="doc_id", text="text", least=LEAST, times=TIMES, batch_bytes=4 << 20) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: the text without the words that a run holds after its first period,
    joined by one space."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("binary").alias("text"))
    out = T.StructType([rows.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(SPAN)), T.StructField("collapsed", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for table in task_batches(batches, None, 1 << 14, batch_bytes):
            texts, numbers = [(t or b"").split() for t in table["text"].to_pylist()], {}
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            codes = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in texts for w in ws), np.int64, int(sizes.sum()))
            spans: list[list] = [[] for _ in texts]
            drop = np.zeros(len(codes) + 1, np.int64)
            begin = np.cumsum(sizes) - sizes
            for i, s, n, p in zip(*(x.tolist() for x in runs_of(codes, sizes, least, times))):
                spans[i].append({"start": s, "length": n, "period": p})
                drop[begin[i] + s + p] += 1
                drop[begin[i] + s + n] -= 1
            keep = (np.cumsum(drop)[:-1] == 0).tolist()
            kept = [b" ".join([w for w, k in zip(ws, keep[b : b + len(ws)]) if k] if spans[i] else ws).decode("utf-8", "replace") for i, (ws, b) in enumerate(zip(texts, begin.tolist()))]
            made = [table["doc"].combine_chunks(), pa.array(sizes), spans, kept]
            schema = to_arrow_schema(out)
            yield from pa.table([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, schema)], schema=schema).to_batches()

    return rows.mapInArrow(run, out).select(F.col("doc").alias(doc_id), "n_words", "runs", "collapsed")


def best_run(runs):
    """The run (a struct, or null) of the greatest length / period; ties: the least start, then the least period. runs: by start, then period."""
    better = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda x, y: F.when(better(x, y), y).otherwise(x))


def run_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[n].cast("string") for n in ("start", "length", "period"))), F.lit("\n"))), "")
    best = found.withColumn("_best", best_run(F.col("runs")))
    return best.select(
        doc_id, F.size("runs").cast("long").alias("n_runs"), *(F.col("_best")[n].alias(n) for n in ("start", "length", "period")),
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: of documents whose crc32 of the decimal doc_id is divisible by ten, the words from a place on are replaced by repeats of the first few of
    them, both taken from that number; a null doc_id changes nothing."""
    ws = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(doc_id).cast("string"))
    named = docs.select(doc_id, text, (h % 10 == 0).alias("_hit"), F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, ws).alias("_w"))
    n, g = F.size("_w"), F.col("_g")
    named = named.withColumn("_a", (g % F.greatest(n, F.lit(1))).cast("int")).withColumn("_p", F.expr("CAST(1 + (size(_w) - _a) div (3 + _g % 8) AS INT)"))
    repeated = F.expr("array_join(transform(sequence(0, size(_w) - 1), i -> _w[CASE WHEN i < _a THEN i ELSE _a + (i - _a) % _p END]), ' ')")
    return named.select(doc_id, F.when(F.col("_hit") & (n > 0), repeated).otherwise(F.col(text)).alias(text))
