"""Language identification of spans: script ranges narrow the candidates, Viterbi labels the words.

Learning: from a sample of labelled documents bounded per language (`per_lang`, taken evenly by a hash of doc_id, if there, and text; a
language of which the sample has no trigram, as one of a few repeated rows, takes all its rows), counts of
letter trigrams (with word borders) per language; a trigram's score is its smoothed log probability. The alphabet
holds every letter of the sample; letters that it lacks count as one. The scripts
in which a language is written are those that hold at least `script_share` of its letters. A language without any letter isn't learned.
Labelling: a word's candidates are the languages written in its script (all, if none is); its score under
each is the sum over its trigrams. Words of other kinds score 0. Viterbi finds the best label sequence when each change of
language costs `switch`; runs of one label are the spans of mixed-language text. The document's language is the one
whose spans hold most letters (ties: the first by name); score is the share of letters in its spans times the
model's belief in it against the other candidates on those spans.

Defined cases: null texts, and texts without a letter, are `und` with score 0. Words of any length are scored
whole. Unlabelled and held-out rows teach nothing; repeated rows are labelled one by one. If no row has a label
every text is `und`. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import task_batches

#: First code points of script ranges and the script of each range (Unicode blocks).
SCRIPT_STARTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD800, 0x20000, 0x30000)
SCRIPT_NAMES = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "devanagari", "bengali", "gurmukhi", "gujarati", "other", "tamil", "telugu", "kannada", "malayalam", "other", "thai", "lao", "tibetan", "myanmar", "georgian", "hangul", "ethiopic", "other", "latin", "greek", "other", "kana", "kana", "other", "hangul", "other", "han", "other", "hangul", "other", "han", "other")
SCRIPTS = sorted(set(SCRIPT_NAMES))
_CODE = np.array([SCRIPTS.index(s) for s in SCRIPT_NAMES], np.int8)

BORDER, RARE = 0, 1  # letter codes: word border, letters outside the alphabet
_TABLE = 1 << 22  # trigrams that are looked up in a table; more are searched, with the same rows


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _CODE[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1]


def _words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the words with a blank before each and one at the end, letters or not)."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, _is_letter(points)


_LETTER = np.zeros(0x30000, np.int8)  # 0: not looked up yet, 1: letter, 2: none


def _is_letter(points: np.ndarray) -> np.ndarray:
    low = np.minimum(points, len(_LETTER) - 1)
    new = np.unique(low[_LETTER[low] == 0])
    for p in new:
        _LETTER[p] = 1 if chr(p).isalpha() else 2
    return _LETTER[low] == 1


class Model:
    """Scores of words under each language."""

    def __init__(self, langs: list[str], alphabet: list[int], index: np.ndarray, scores: np.ndarray, floor: np.ndarray, writes: np.ndarray):
        self.langs, self.floor, self.writes = langs, floor, writes
        self.codes = np.full(0x30000, RARE, np.int64)
        self.codes[alphabet] = np.arange(2, len(alphabet) + 2)
        self.size, self.index, self.scores = len(alphabet) + 2, index, scores
        self.kinds: np.ndarray | None = None  # sorted trigrams, where a table of all would be too large

    def rows(self, gram: np.ndarray) -> np.ndarray:
        """Rows of trigrams in the scores; -1: not learned."""
        if self.kinds is None:
            return self.index[gram]
        at = np.minimum(np.searchsorted(self.kinds, gram), len(self.kinds) - 1)
        return np.where(self.kinds[at] == gram, at, -1)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages, letters per word)."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        points, letter = _flat(words)
        blank = points == 32
        code = np.where(letter, self.codes[np.minimum(points, 0x2FFFF)], BORDER)
        # Trigrams around each letter: what stands before, the letter, what stands behind.
        at = np.flatnonzero(letter)
        gram = (code[at - 1] * self.size + code[at]) * self.size + code[at + 1]
        row = self.rows(gram)
        value = np.where((row >= 0)[:, None], self.scores[np.maximum(row, 0)], self.floor[None, :])
        word = np.cumsum(blank)[at] - 1
        out = np.zeros((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word, weights=value[:, k], minlength=len(words))
        letters = np.bincount(word, minlength=len(words))
        # Only languages written in one of the word's scripts are candidates.
        script = np.zeros((len(words), len(SCRIPTS)), bool)
        script[word, scripts_of(points[at])] = True
        fits = (script.astype(np.float32) @ self.writes.T.astype(np.float32)) > 0
        fits |= ~fits.any(axis=1)[:, None]
        out = np.where(fits | (letters == 0)[:, None], out, out.min(axis=1)[:, None] - 20.0)
        return out.astype(np.float32), letters


def learn(docs: DataFrame, *, text="text", lang="lang", doc_id="doc_id", per_lang=1500, script_share=0.02) -> Model | None:
    """A model from at most about per_lang documents of each language. What reaches the driver are trigram counts of that sample."""
    lot = F.pmod(F.xxhash64(*([doc_id] if doc_id in docs.columns else []), text, F.lit(7)), F.lit(1 << 20))
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), lot.alias("lot"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n)))), F.col("lang"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def grams(batches):
        from collections import Counter

        import pyarrow as pa

        for table in task_batches(batches, None, 2048, 8 << 20):
            count: Counter = Counter()
            for t, l in zip(table["text"].to_pylist(), table["lang"].to_pylist()):
                points, letter = _flat(_words(t))
                p = np.where(letter, np.minimum(points, 0x2FFFF), 0).astype(np.uint64)
                at = np.flatnonzero(letter)
                k, n = np.unique((p[at - 1] << np.uint64(40)) | (p[at] << np.uint64(20)) | p[at + 1], return_counts=True)
                for x, m in zip(k.tolist(), n.tolist()):
                    count[l, x] += m
            keys = list(count)
            yield from pa.table([pa.array([k[0] for k in keys], pa.string()), pa.array([str(k[1]) for k in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())], names=schema.names).to_batches()

    counted = lambda some: some.select("text", "lang").mapInArrow(grams, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    found = counted(rows.filter(F.col("lot") < share * (1 << 20)))
    missed = sorted(set(sizes) - set(found["lang"]))
    if missed:
        rest = counted(rows.filter(F.col("lang").isin(missed)))
        found = pd.concat([found, rest], ignore_index=True) if len(found) else rest
    sizes = {k: sizes[k] for k in set(found["lang"])}
    if not sizes:
        return None
    langs = sorted(sizes)
    number = {l: i for i, l in enumerate(langs)}
    gram = found["gram"].astype(np.uint64).to_numpy() if len(found) else np.zeros(0, np.uint64)
    n, l = found["n"].to_numpy(np.int64), found["lang"].map(number).to_numpy(np.int64) if len(found) else np.zeros(0, np.int64)
    a, b, c = ((gram >> np.uint64(s)).astype(np.int64) & 0xFFFFF for s in (40, 20, 0))
    # Scripts: of the middle letters.
    script = np.zeros((len(langs), len(SCRIPTS)))
    if len(gram):
        np.add.at(script, (l, scripts_of(b)), n)
    writes = script >= script_share * np.maximum(script.sum(axis=1, keepdims=True), 1)
    model = Model(langs, np.unique(b).tolist(), np.zeros(0, np.int32), np.zeros((0, 0)), np.zeros(0), writes)
    size = model.size
    code = lambda p: np.where(p == 0, BORDER, model.codes[p])
    key = (code(a) * size + code(b)) * size + code(c)
    kinds, at = np.unique(key, return_inverse=True)
    count = np.zeros((len(kinds), len(langs)))
    if len(gram):
        np.add.at(count, (at, l), n)
    total = count.sum(axis=0, keepdims=True)
    smooth = 0.5
    bottom = np.log(total + smooth * (len(kinds) + 1))
    if size**3 <= _TABLE:
        model.index = np.full(size**3, -1, np.int32)
        model.index[kinds] = np.arange(len(kinds))
    else:
        model.kinds = kinds
    model.scores = (np.log(count + smooth) - bottom).astype(np.float32)
    model.floor = (np.log(smooth) - bottom)[0].astype(np.float32)
    return model


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of all words; scores: (words of all texts, languages); sizes: words per text. Steps run over all texts at once."""
    order = np.argsort(-sizes, kind="stable")
    start, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    label = np.zeros(len(scores), np.int16)
    steps = int(size[0]) if len(size) else 0
    if not steps:
        return label
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # texts longer than each step
    best = np.empty((len(scores), 1), np.int16)
    stay = np.empty(scores.shape, bool)
    v = scores[start[: live[0]]].astype(np.float64)
    last = np.empty((len(size), scores.shape[1]))
    for t in range(1, steps):
        k = live[t]
        if k < len(v):
            last[k : len(v)] = v[k:]
            v = v[:k]
        at = start[:k] + t
        top = v.argmax(axis=1)
        jump = v[np.arange(k), top][:, None] - switch
        best[at, 0] = top
        stay[at] = v >= jump
        v = np.maximum(v, jump) + scores[at]
    last[: len(v)] = v
    now = last[: live[0]].argmax(axis=1).astype(np.int16)
    now = np.concatenate((now, np.zeros(len(size) - live[0], np.int16)))
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = start[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = np.where(stay[at, now[:k]], now[:k], best[at, 0])
    return label


def identify(docs: DataFrame, model: Model | None, *, text="text", switch=12.0, with_spans=False) -> DataFrame:
    """docs with lang_pred, score and, if asked, spans (lang, first word, end word) of the words split at white space."""
    docs = docs.drop("lang_pred", "score", "lang_spans")
    spans_t = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("lang_spans", spans_t)] if with_spans else [])])
    if model is None:
        out = docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
        return out.withColumn("lang_spans", F.lit(None).cast(spans_t)) if with_spans else out
    added = schema.fields[len(docs.columns) :]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for table in task_batches(batches, None, 4096, 8 << 20):
            number: dict[str, int] = {}
            parts, sizes = [], np.zeros(table.num_rows, np.int64)
            for i, t in enumerate(table[text].to_pylist()):
                ws = _words(t)
                sizes[i] = len(ws)
                parts.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)))
            ids = np.concatenate(parts)
            by_word, letters = m.score(list(number))
            n_langs = len(m.langs)
            pred, conf = np.full(len(sizes), -1), np.zeros(len(sizes))
            if len(ids):
                label = viterbi(by_word[ids], sizes, switch)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                held = np.bincount(doc * n_langs + label, weights=letters[ids], minlength=len(sizes) * n_langs).reshape(-1, n_langs)
                some = held.sum(axis=1) > 0
                pred = np.where(some, held.argmax(axis=1), -1)
                own = label == pred[doc]
                total = np.stack([np.bincount(doc[own], weights=by_word[ids[own], k], minlength=len(sizes)) for k in range(n_langs)], axis=1)
                rel = total - total[np.arange(len(sizes)), np.maximum(pred, 0)][:, None]
                belief = 1 / np.exp(np.minimum(rel, 50)).sum(axis=1)
                conf = np.where(some, held.max(axis=1) / np.maximum(held.sum(axis=1), 1) * belief, 0.0)
            cols = [pa.array([m.langs[p] if p >= 0 else "und" for p in pred], pa.string()), pa.array(conf, pa.float64())]
            if with_spans:
                ends = np.cumsum(sizes)
                spans = []
                for i in range(len(sizes)):
                    lab = label[ends[i] - sizes[i] : ends[i]] if len(ids) else []
                    edge = [0, *(np.flatnonzero(np.diff(lab)) + 1), len(lab)] if len(lab) else []
                    spans.append([{"lang": m.langs[lab[a]], "start": int(a), "end": int(b)} for a, b in zip(edge, edge[1:])])
                cols.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
            for f, c in zip(added, cols):
                table = table.append_column(f.name, c)
            yield from table.to_batches()

    return docs.mapInArrow(run, schema)


def filter_languages(docs: DataFrame, *, text="text", lang="lang", min_score=0.1, sure=0.98, model: Model | None = None) -> DataFrame:
    """docs without texts that have no language: no letter, or nothing that speaks for one language (score under min_score). A null lang is
    set to the language found, and one that names another language where the score is at least `sure` is set right."""
    model = model or learn(docs, text=text, lang=lang)
    if model is None:
        return docs
    kept = {"lang_pred": "__lexmill_l", "score": "__lexmill_s"}
    named = docs.withColumnsRenamed(kept)
    named = identify(named, model, text=text).filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    label = kept.get(lang, lang)
    if label in named.columns:
        right = F.when(F.col(label).isNull() | (F.col("score") >= sure), F.col("lang_pred")).otherwise(F.col(label))
        named = named.withColumn(label, right.cast(docs.schema[lang].dataType))
    return named.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in kept.items()})
