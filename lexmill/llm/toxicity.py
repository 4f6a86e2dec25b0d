"""Toxicity by a support vector machine on a string kernel of sentences, with Nystroem landmarks.

Kernel of words: the triples of letters (borders are letters, too) that both hold in order, with gaps; a triple that spans d letters
more than three weighs decay^d, up to `SPAN` letters; it is divided by a word's norm as its length gives it. Inserted
characters therefore lower a similarity instead of ending it. Marks inside a word are left out, letters written one by one are joined.
Kernel of sentences: the sum over all pairs of their words, over the root of both numbers of words. A sentence of more than CLAUSE words is
read in overlapping clauses of that size.
Learning: from a sample of at most about `sample_docs` labelled documents of each label (taken evenly by a hash of the id; texts of more than
`sample_bytes` bytes teach nothing), split into sentences; equal ones count once. Sentences of toxic documents that hold a word which
stands in more toxic sentences than chance allows are positive examples, with copies in which that word has a character
inserted; the other sentences of toxic documents teach nothing. Sentences of benign
documents, about `most` of their clauses by lot, are negative ones (as many positive ones at most): `benign` of them at first, and in each round at most `hard` more that the machine takes for toxic. Landmarks are
one-word sentences, chosen greedily among the words of positive examples by kernel distance, and the benign words most like them; sentences are mapped to
K(sentence, landmarks) K(landmarks, landmarks)^-1/2 and a linear machine with squared hinge loss is trained on them. Its weights fold back into one
table over hashed triples of 2^TABLE entries, so a sentence is scored by summing table entries, without the landmarks.
Scoring: a text scores the highest value among its sentences (the machine's bias if it has none), turned into a
probability by a logistic fit on the sample, whose labels are weighted to their true shares.

Defined cases: null and empty texts score as texts without a suspicious word. Texts are scored whole, whatever their
length. Without labelled rows of both kinds, or a significant word, all texts get the share of toxic labels (0 if none).
Repeated rows are scored one by one. An empty table gives no row. Extra columns are kept.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import task_batches

SPAN, DECAY = 6, 0.7
#: (first step, second step, weight) of the triples in a span.
_STEPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, SPAN) for b in range(1, SPAN - a)]
TABLE = 21  # bits of a hashed triple
CLAUSE = 2


def plain(word: str) -> str:
    """Lower case, letters and digits only."""
    w = word.lower()
    return w if w.isalnum() else "".join(c for c in w if c.isalnum())


def spelled(words: list[str]) -> list[str]:
    """Runs of three or more single letters, joined."""
    out, run = [], ""
    for w in [*words, ""]:
        p = plain(w) if len(w) <= 3 else w
        if len(p) == 1:
            run += p
        else:
            if len(run) >= 3:
                out.append(run)
            run = ""
    return out


#: Borders count as letters, so a word differs from a longer one that holds it.
FIRST, LAST = "<", ">"


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, hashed triple, weight over the word's norm) of every triple of letters and borders; empty words have none."""
    words = [FIRST + w + LAST if w else "" for w in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    word = np.repeat(np.arange(len(words)), sizes)
    norm = np.sqrt(np.maximum(sum(w * w * np.maximum(sizes - a - b, 0) for a, b, w in _STEPS), 1e-9))
    rows, cols, vals = [], [], []
    parts = _parts(points)
    for a, b, w in _STEPS:
        n = len(points) - a - b
        if n <= 0:
            continue
        at = np.flatnonzero(word[:n] == word[a + b :])
        rows.append(word[at])
        cols.append(_column(parts, a, b, n)[at])
        vals.append(w / norm[word[at]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cols]).astype(np.int64), np.concatenate([np.zeros(0), *vals])


def _parts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a letter adds to a triple's hash as its first, second and third."""
    one, two, three = (points * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
    return one, (two >> np.uint32(5)) ^ (two << np.uint32(11)), (three << np.uint32(7)) ^ (three >> np.uint32(3))


def _column(parts, a: int, b: int, n: int) -> np.ndarray:
    x = parts[0][:n] ^ parts[1][a : a + n] ^ parts[2][a + b :]
    return ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - TABLE)


class Units(dict):
    """raw word -> its plain form, for words met before; bounded."""

    def __missing__(self, w):
        if len(self) > 400_000:
            self.clear()
        x = self[w] = plain(w)
        return x


BREAK = "\0"  # stands between sentences


def broken(text: str | None) -> list[str]:
    """The raw words of a text, with BREAK at both ends and between sentences."""
    if not text:
        return [BREAK]
    for mark in ".!?\n":
        text = text.replace(mark, " \0 ")
    return [BREAK, *text.split(), BREAK]


def sentences(text: str | None) -> list[list[str]]:
    """The raw words of a text's sentences."""
    out: list[list[str]] = [[]]
    for w in broken(text):
        if w != BREAK:
            out[-1].append(w)
        elif out[-1]:
            out.append([])
    return out[:-1] if not out[-1] else out


class Scorer:
    """f(sentence) = bias + sum of its words' values / root of their number; then a logistic on a text's highest value."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.bias, self.slope, self.shift = bias, slope, shift
        self.table = np.zeros(1 << TABLE, np.float32)
        self.table[columns] = weights

    def words(self, words: list[str], part: int = 20_000) -> np.ndarray:
        """Values of plain words: the folded machine's sum over their triples. Some words at a time (a longer one alone)."""
        out = np.zeros(len(words))
        lo = 0
        while lo < len(words):
            hi, size = lo, 0
            while hi < len(words) and hi - lo < part and size < 16 * part:
                size, hi = size + len(words[hi]) + 2, hi + 1
            some = [FIRST + w + LAST if w else "" for w in words[lo:hi]]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # letters from here to the word's end
            parts, value = _parts(points), np.zeros(len(points))
            for a, b, w in _STEPS:
                n = len(points) - a - b
                if n > 0:
                    value[:n] += np.where(left[:n] > a + b, self.table[_column(parts, a, b, n)], 0) * w
            norm = np.sqrt(np.maximum(sum(w * w * np.maximum(sizes - a - b, 0) for a, b, w in _STEPS), 1e-9))
            out[lo:hi] = np.bincount(np.repeat(np.arange(len(some)), sizes), weights=value, minlength=len(some)) / norm
            lo = hi
        return out

    def texts(self, texts: list[str | None], known: dict[str, float]) -> np.ndarray:
        """The highest sentence of each text. known: values of words met before, by their raw form (nan: no letter or digit in it)."""
        split = [broken(t) for t in texts]
        known[BREAK] = -np.inf
        new = list({w for ws in split for w in ws if w not in known})
        forms = [plain(w) for w in new]
        known.update(zip(new, np.where(np.fromiter(map(len, forms), np.int64, len(forms)) > 0, self.words(forms), np.nan).tolist()))
        single = known.setdefault("", set())  # words that spelled() may join; no word is empty
        single.update(w for w, p in zip(new, forms) if len(w) <= 3 and len(p) == 1)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        value = np.fromiter(map(known.__getitem__, (w for ws in split for w in ws)), np.float64, int(sizes.sum()))
        text = np.repeat(np.arange(len(split)), sizes)
        real = ~np.isnan(value)
        value, text = value[real], text[real]
        ends = np.isinf(value)
        best = np.full(len(split), -np.inf)
        total = np.zeros(len(value))
        for n in range(1, CLAUSE + 1):  # clauses of n words: shorter ones only where they are a whole sentence
            m = len(value) - n + 1
            if m <= 0:
                break
            total = total[:m] + value[n - 1 :]
            this = total / np.sqrt(n)
            if n < CLAUSE:
                whole = np.zeros(m, bool)
                whole[1:-1] = ends[: m - 2] & ends[n + 1 :]
                this = np.where(whole, this, -np.inf)
            np.maximum.at(best, text[:m], this)
        out = self.bias + np.where(np.isinf(best), 0.0, np.maximum(best, 0.0))
        for i, ws in enumerate(split):
            if not single.isdisjoint(ws) and sum(map(single.__contains__, ws)) >= 3 and (joined := spelled(texts[i].split())):
                out[i] = max(out[i], self.bias + self.words(joined).max())  # a joined word is a sentence of its own
        return out

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * values + self.shift)))


def _tail(pos: int, n: int, share: float) -> float:
    """P(at least pos of n) for the given share of each (log domain; exact sum)."""
    lg = math.lgamma
    terms = [lg(n + 1) - lg(k + 1) - lg(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(pos, n + 1)]
    top = max(terms)
    return math.exp(top) * sum(math.exp(t - top) for t in terms)


def _svm(x: np.ndarray | Sentences, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, at: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Primal squared-hinge machine by Newton steps over the rows inside the margin. at: the numbers of the rows of x that y and weight belong to (all)."""
    at = np.arange(len(x)) if at is None else at
    w = np.zeros(x.shape[1] + 1)
    reg = np.full(len(w), ridge * weight.sum())
    reg[-1] = 1e-9
    for _ in range(60):
        a, b = np.diag(reg), np.zeros(len(w))
        for lo in range(0, len(at), 8192):  # a few rows at a time in double precision; all of them are never held
            some, yi = x[at[lo : lo + 8192]], y[lo : lo + 8192]
            zi = np.ones((len(some), len(w)))
            zi[:, :-1] = some
            inside = yi * (zi @ w) < 1
            zi = zi[inside]
            zw = zi * weight[lo : lo + 8192][inside, None]
            a, b = a + zw.T @ zi, b + zw.T @ yi[inside]
        new = np.linalg.solve(a, b)
        step = new - w
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[dict, list]:
    """About `most` documents of each label, by a hash of their ids; and each label's number of documents.

    Only the chosen ids, a bounded list, meet the documents, so no text is shuffled.
    """
    stat = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = F.when(F.col("toxic") == 1, min(1.0, most / max(stat.get(1, 0), 1))).otherwise(min(1.0, most / max(stat.get(0, 0), 1)))
    chosen = labels.filter(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 20)) < part * (1 << 20))
    got = docs.join(F.broadcast(chosen), "_id").select("text", "toxic").collect()
    return stat, sorted({(r.text or "", int(r.toxic)) for r in got})


def dense_rows(words: list[str], columns: np.ndarray) -> np.ndarray:
    """Words' weights over the given triples."""
    row, col, val = triples(words)
    at = np.minimum(np.searchsorted(columns, col), len(columns) - 1)
    own = columns[at] == col
    out = np.zeros((len(words), len(columns)), np.float32)
    np.add.at(out, (row[own], at[own]), val[own])
    return out


def word_features(words: list[str], columns: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Words' rows over the given triples, times maps."""
    out = np.zeros((len(words), maps.shape[1]), np.float32)
    row, col, val = triples(words)
    at = np.minimum(np.searchsorted(columns, col), len(columns) - 1)
    own = np.flatnonzero(columns[at] == col)
    own = own[np.argsort(row[own], kind="stable")]
    row, at, val = row[own], at[own], val[own].astype(np.float32)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    if len(first):
        out[row[first]] = np.add.reduceat(maps[at] * val[:, None], first, axis=0)
    return out


class Sentences:
    """Sentences' rows, made from those of their words when they are asked for. A word's row is held once, however many sentences have it."""

    def __init__(self, lists: list[list[str]], columns: np.ndarray, maps: np.ndarray, part: int = 250):
        number: dict[str, int] = {}
        self.word = np.fromiter((number.setdefault(w, len(number)) for s in lists for w in s), np.int64)
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.words, names = np.zeros((len(number), maps.shape[1]), np.float32), list(number)
        for lo in range(0, len(names), part):  # some words at a time: each has a row for every triple meanwhile
            self.words[lo : lo + part] = word_features(names[lo : lo + part], columns, maps)
        self.shape = len(lists), maps.shape[1]

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        sizes, first = self.sizes[at], self.first[at]
        out = self.words[self.word[first]]
        for n in range(1, int(sizes.max(initial=0))):
            longer = np.flatnonzero(sizes > n)
            out[longer] += self.words[self.word[first[longer] + n]]
        out /= np.sqrt(sizes).astype(np.float32)[:, None]
        return out


def sentence_features(lists: list[list[str]], columns: np.ndarray, maps: np.ndarray, part: int = 250) -> np.ndarray:
    """Sentences' rows, all at once."""
    return Sentences(lists, columns, maps, part)[np.arange(len(lists))]


def _clauses(sentence: list[str]) -> list[list[str]]:
    """A sentence, or its clauses."""
    return [sentence[i : i + CLAUSE] for i in range(max(1, len(sentence) - CLAUSE + 1))]


def learn(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", toxic="toxic", sample_docs=2500, sample_bytes=64 << 10, most=45_000, benign=8_000, hard=6_000, landmarks=400, rounds=4, seed=3) -> Scorer | float:
    """A scorer from labelled documents, or the share of toxic labels where nothing can be learned. The sample, bounded by sample_docs and
    sample_bytes, goes to the driver."""
    marks = labels.filter(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    short = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).filter(F.col("text").isNull() | (F.octet_length("text") <= sample_bytes))
    stat, sample = _sample(short, marks, sample_docs)
    n_pos, n_neg = stat.get(1, 0), stat.get(0, 0)
    prior = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0
    if not n_pos or not n_neg:
        return prior
    form, lot = Units(), np.random.Generator(np.random.PCG64(seed))

    def each(label: int):
        """The distinct sentences of one label's texts as plain words; joined letters are sentences of their own."""
        met = set()
        for t, y in sample:
            if y == label:
                for s in [*sentences(t), *([j] for j in spelled(t.split()))]:
                    ps = [p for p in map(form.__getitem__, s) if p]
                    if ps and (h := hash(tuple(ps))) not in met:
                        met.add(h)
                        yield ps

    count, number = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}
    clauses = 0
    for y in (1, 0):
        for ps in each(y):
            number[y] += 1
            count[y].update({w for w in ps if len(w) > 2 and (y or w in count[1])})
            clauses += 0 if y else max(1, len(ps) - CLAUSE + 1)
        if y:
            count[1] = Counter({w: n for w, n in count[1].items() if n >= 2})
    pos, neg = count[1], count[0]
    share = min(max(number[1] / max(number[0] + number[1], 1), 1e-6), 1 - 1e-6)
    tried = list(pos)
    good = [w for w in tried if _tail(pos[w], pos[w] + neg[w], share) * max(len(tried), 1) < 0.01 and pos[w] / (pos[w] + neg[w]) >= (1 + share) / 2]
    if not good:
        return prior
    good.sort(key=lambda w: (-pos[w], w))
    picked = set(good)
    rng = np.random.Generator(np.random.PCG64(seed + 1))

    def inserted(w: str) -> str:
        at = int(rng.integers(1, len(w)))
        return w[:at] + "0123456789xzq"[int(rng.integers(0, 13))] + w[at:]

    positive = [list(c) for c in dict.fromkeys(tuple(c) for s in each(1) if not picked.isdisjoint(s) for c in _clauses(s) if not picked.isdisjoint(c))]
    positive = [positive[i] for i in np.sort(lot.permutation(len(positive))[:most])]
    positive += [[inserted(w) if w in picked else w for w in c] for c in positive] + [[w] for w in good] + [[inserted(w)] for w in good]
    part = min(1.0, most / max(clauses, 1))
    every = [c for s in each(0) if part == 1.0 or lot.random() < part for c in _clauses(s)]
    if not every:
        return prior
    # Landmarks: each next one is the positive word least like those chosen; and the benign words most like them.
    columns = np.unique(triples([*good, *map(inserted, good)])[1])
    dense = dense_rows(good, columns)
    chosen, like = [0], dense @ dense[0]
    while len(chosen) < min(landmarks * 3 // 4, len(good)):
        nxt = int(np.argmin(like))
        if like[nxt] > 0.98:
            break
        chosen.append(nxt)
        like = np.maximum(like, dense @ dense[nxt])
    names = [w for w in dict.fromkeys(w for c in every for w in c) if w not in picked]
    near = np.ascontiguousarray(dense[chosen].T)
    close = np.concatenate([word_features(names[i : i + 3000], columns, near).max(axis=1) for i in range(0, len(names), 3000)] or [np.zeros(0)])
    extra = [i for i in np.argsort(-close, kind="stable")[: max(4, landmarks - len(chosen))] if close[i] > 0]
    land = np.concatenate((dense[chosen], dense_rows([names[i] for i in extra], columns))).astype(np.float64)
    lam, vec = np.linalg.eigh(land @ land.T + 1e-6 * np.eye(len(land)))
    maps = land.T @ (vec @ np.diag(np.maximum(lam, 1e-6) ** -0.5) @ vec.T)
    used = set(lot.permutation(len(every))[:benign].tolist())
    del dense, near, close, land, names
    x, n_x = Sentences(positive + every, columns, maps.astype(np.float32)), len(positive)
    for turn in range(rounds):
        if turn:
            value = np.concatenate([x[np.arange(lo, min(lo + 8192, len(x)))] @ w_ for lo in range(n_x, len(x), 8192)]) + bias
            used.update(int(i) for i in np.argsort(-value, kind="stable")[:hard] if value[i] > -0.8)
        y = np.concatenate((np.ones(n_x), -np.ones(len(used))))
        weight = np.where(y > 0, 0.5 / n_x, 0.5 / len(used)) * len(y)
        w_, bias = _svm(x, y, weight, 1e-5, np.concatenate((np.arange(n_x), n_x + np.array(sorted(used), np.int64))))
    scorer = Scorer(columns, (maps @ w_).astype(np.float32), float(bias), 1.0, 0.0)
    del x, every, positive
    value = np.concatenate([scorer.texts([t for t, _ in sample[i : i + 100]], {}) for i in range(0, len(sample), 100)])
    label = np.array([y for _, y in sample])
    scorer.slope, scorer.shift = _logistic(value, label, n_pos, n_neg)
    return scorer


def _logistic(value: np.ndarray, label: np.ndarray, n_pos: int, n_neg: int) -> tuple[float, float]:
    """Slope and shift of a logistic fit whose labels weigh as their true numbers; a small penalty keeps the slope finite."""
    weight = np.where(label == 1, n_pos / max((label == 1).sum(), 1), n_neg / max((label == 0).sum(), 1)) / (n_pos + n_neg)
    z, theta = np.stack([value, np.ones(len(value))], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ theta))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-4, 1e-7])
        step = np.linalg.solve(h, z.T @ (weight * (label - p)) - np.array([1e-4, 1e-7]) * theta)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def score_texts(docs: DataFrame, scorer: Scorer | float, *, text="text", out="score") -> DataFrame:
    """docs with the probability of toxicity of each text."""
    docs = docs.drop(out)
    if isinstance(scorer, float):
        return docs.withColumn(out, F.lit(scorer))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        import pyarrow as pa

        s, known = sent.value, {}
        for table in task_batches(batches, None, 4096, 4 << 20):
            if len(known) > 500_000:
                known.clear()
            yield from table.append_column(out, pa.array(s.probability(s.texts(table[text].to_pylist(), known)), pa.float64())).to_batches()

    return docs.mapInArrow(run, schema)
