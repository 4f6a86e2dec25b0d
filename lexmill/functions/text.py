"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of tokens, control characters and white space.
NOT_WORD = r"[^\p{L}\p{N}_]+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
EDGES = r"(?U)^\s+|\s+$"
SENTENCE_END = r"([.!?])\s+"
TRUNCATED = " [... truncated]"

# Function words left out of queries, and the short list of the evaluation runs.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had "
    "do does did will would could should may might shall it its this that these those what which who how when "
    "where why all each both more most also than then so if as up out about into through during before after "
    "between such their our your my his her we they you he she i not no can just any some much many over"
).split()
SHORT_STOP_WORDS = "a an the and or but in on at to for of with by from is are was were be this that".split()


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case ASCII words of at least `least` letters that no letter, digit or underscore touches."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda x: x.rlike(f"^[a-z]{{{least},}}\\z"))


def term_counts(toks: Column) -> Column:
    """Array of (term, tf) of an array of tokens, in the order of terms: inside the row, without a shuffle. Null for null."""

    def runs(s):
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        until = lambda f, j: F.coalesce(F.get(f, j + 1), F.size(s))
        return _bound(first, lambda f: F.transform(f, lambda i, j: F.struct(F.get(s, i).alias("term"), (until(f, j) - i).cast("long").alias("tf"))))

    none = F.expr("cast(array() as array<struct<term: string, tf: bigint>>)")
    return F.when(F.size(toks) == 0, none).when(toks.isNotNull(), _bound(F.sort_array(toks), runs))


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once: it is bound as a lambda's argument."""
    return F.transform(F.array(value), f)[0]


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: a filter on a plain one would be pushed below it and compute it again."""
    return df.withColumn(name, F.explode(F.array(value)))


def word_tokens(text: Column, least: int) -> Column:
    """Lower-case runs of at least `least` letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda x: F.length(x) >= least)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, EDGES, "")


def _composed(t: str | None) -> str | None:
    return None if t is None else unicodedata.normalize("NFKC", t)


#: Rows go to the worker a hundred at a time, so its memory doesn't grow with the rows of a task.
_compose = F.udf(_composed, StringType(), useArrow=False)


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition; the JVM side has no function for it. ASCII texts stay in the JVM."""
    return F.coalesce(_compose(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def normalise(text: Column, compose: bool = True) -> Column:
    return strip(F.regexp_replace(nfkc(text) if compose else text, CONTROL, ""))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two token sets; `empty` is the value of two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cut_at_blank(text: Column, limit: int, suffix: str = "") -> Column:
    """Texts over the limit: the first `limit` characters up to their last blank (all, if nothing stands before it), and the suffix."""
    head = F.substring(text, 1, limit)
    cut = F.coalesce(F.nullif(F.regexp_replace(head, r"(?s)^(.*) [^ ]*\z", "$1"), F.lit("")), head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(suffix)))


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ? before white space; stripped, without empty ones."""
    marked = F.split(F.regexp_replace(text, SENTENCE_END, "$1\x01"), "\x01")
    return F.filter(F.transform(marked, strip), lambda x: x != "")


def preprocess(query: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """A query's tokens without stop words; the lower-cased query if none is left."""
    kept = content_tokens(query, stop)
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.lower(query))


def content_tokens(query: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    stop = list(stop)
    return F.filter(tokens(query), lambda t: ~t.isin(stop))


def stripped_words(query: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """The distinct tokens of a query that preprocess() leaves out, in order."""
    stop = list(stop)
    return F.array_sort(F.array_distinct(F.filter(tokens(query), lambda t: t.isin(stop))))


def snippet(text: Column, limit: int = 160) -> Column:
    return F.replace(F.substring(text, 1, limit), F.lit("\n"), F.lit(" "))


def preview(text: Column, limit: int = 400) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def count_present(text: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases stand in the text, however often each does."""
    return functools.reduce(lambda a, b: a + b, (F.contains(text, F.lit(p)).cast("int") for p in phrases))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded half away from zero; what is negative keeps its sign where it becomes zero, as SQL engines and numpy have it."""
    return F.round(F.abs(x), digits) * F.signum(x)


def l2_normalise(v: Column) -> Column:
    """A vector of length 1; a zero vector is divided by 1e-10."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1e-10)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = lambda v: F.sqrt(dot(v, v))
    return dot(a, b) / (F.when(n(a) == 0, 1e-10).otherwise(n(a)) * F.when(n(b) == 0, 1e-10).otherwise(n(b)))
