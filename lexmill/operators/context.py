"""Context windows: a bounded selection of ranked chunks, per query, joined into one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_CHARS, MIN_SCORE, TOP_K, MMR_LIMIT = 3000, 0.20, 5, 0.85


def effective_score(hybrid, vector):
    """The hybrid score unless it is null or 0, then the vector score likewise, then 0."""
    zero = F.lit(0.0)
    return F.coalesce(F.nullif(hybrid, zero), F.nullif(vector, zero), zero)


def format_chunk(i, source, score, text):
    return F.concat(F.format_string("[Document %d | source: %s | relevance: %.3f]", i, source, score), F.lit("\n"), text)


def _ranked(results: DataFrame, top_k: int):
    """Per query the first top_k results as an array of (rank, source, text, score)."""
    first = results.filter(F.col("rank") <= top_k).withColumn("score", effective_score(F.col("hybrid_score"), F.col("vector_score")))
    item = F.struct("rank", "source", "text", "score")
    return first.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"))


def _joined(chunks):
    """The chunks' texts with headers numbered from 1, with a blank line between them."""
    return F.array_join(F.transform(chunks, lambda c, i: format_chunk(i + 1, c["source"], c["score"], c["text"])), "\n\n")


def _by_score(chunks):
    """Descending by score, ties in rank order."""
    keyed = F.array_sort(F.transform(chunks, lambda c: F.struct((-c["score"]).alias("s"), c["rank"].alias("r"), c.alias("c"))))
    return F.transform(keyed, lambda x: x["c"])


def _finish(df: DataFrame, strategy: str, max_chars: int, *extra) -> DataFrame:
    full = _joined(F.col("used"))
    cut = tx.cut_at_blank(full, max_chars, tx.TRUNCATED)
    return df.withColumn("context", cut).select(
        "query_id", F.lit(strategy).alias("strategy"), "context", F.size("used").alias("chunks_used"), F.length(full).alias("chars_before"), F.length("context").alias("chars_after"),
        (F.length(full) > max_chars).alias("truncated"), F.transform("used", lambda c: c["score"]).alias("scores"), *extra,
    )


def truncation(results: DataFrame, max_chars: int = MAX_CHARS, top_k: int = TOP_K, **_) -> DataFrame:
    return _finish(_ranked(results, top_k).withColumn("used", F.col("all")), "truncation", max_chars)


def _passing(results: DataFrame, top_k: int, min_score: float) -> DataFrame:
    """Adds the chunks of at least min_score by descending score; the first chunk if there is none."""
    good = _by_score(F.filter("all", lambda c: c["score"] >= min_score))
    return _ranked(results, top_k).withColumn("good", good)


def ranking(results: DataFrame, max_chars: int = MAX_CHARS, top_k: int = TOP_K, min_score: float = MIN_SCORE, **_) -> DataFrame:
    df = _passing(results, top_k, min_score).withColumn("used", F.when(F.size("good") == 0, F.slice("all", 1, 1)).otherwise(F.col("good")))
    return _finish(df, "ranking", max_chars, (F.lit(top_k) - F.size("used")).alias("chunks_filtered_out"))


def mmr(results: DataFrame, max_chars: int = MAX_CHARS, top_k: int = TOP_K, min_score: float = MIN_SCORE, limit: float = MMR_LIMIT, **_) -> DataFrame:
    """As ranking, but a chunk whose token Jaccard with any chosen one reaches the limit is skipped."""
    df = _passing(results, top_k, min_score)
    kind = df.schema["good"].dataType.simpleString()
    start = F.expr(f"named_struct('sel', cast(array() as {kind}), 'skip', 0)")
    toks = lambda c: F.array_distinct(tx.tokens(c["text"]))

    def step(state, c):
        near = F.exists(state["sel"], lambda s: tx.jaccard(toks(s), toks(c)) >= limit)
        return F.struct(F.when(near, state["sel"]).otherwise(F.array_append(state["sel"], c)).alias("sel"), (state["skip"] + near.cast("int")).alias("skip"))

    df = df.withColumn("fold", F.aggregate("good", start, step))
    df = df.withColumn("used", F.when(F.size("fold.sel") == 0, F.slice("all", 1, 1)).otherwise(F.col("fold.sel")))
    return _finish(df, "mmr", max_chars, F.col("fold.skip").alias("duplicates_skipped"))


STRATEGIES = {"truncation": truncation, "ranking": ranking, "mmr": mmr}


def build_context(results: DataFrame, strategy: str = "ranking", **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    return STRATEGIES[strategy](results, **options)


def make_manager(strategy: str, **options):
    """A function of results alone."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    return lambda results: STRATEGIES[strategy](results, **options)
