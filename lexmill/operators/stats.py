"""Statistics of chunks: sizes, vocabulary, and a keyword proxy of retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.work import written


def size_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg("char_count").alias("chars_mean"), sd("char_count").alias("chars_std"), F.min("char_count").alias("chars_min"), F.max("char_count").alias("chars_max"),
        F.avg("word_count").alias("words_mean"), sd("word_count").alias("words_std"),
    )


def size_quartiles(chunks: DataFrame, by: list[str], value: str = "char_count") -> DataFrame:
    return chunks.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q")).select(*by, *(F.col("q")[i].alias(n) for i, n in enumerate(("q0", "q25", "q50", "q75", "q100"))))


def vocabulary_stats(chunks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Tokens, distinct tokens, their ratio, and the mean number of distinct tokens per chunk."""
    toks = chunks.select(*by, tx.tokens(F.col(text)).alias("t"))
    per = toks.groupBy(*by).agg(F.sum(F.size("t")).alias("total_tokens"), F.avg(F.size(F.array_distinct("t"))).alias("avg_unique"))
    kinds = toks.select(*by, F.explode("t").alias("w")).groupBy(*by, "w").agg(F.lit(1)).groupBy(*by).agg(F.count(F.lit(1)).alias("unique_tokens"))
    out = per.join(kinds, by, "left").withColumn("unique_tokens", F.coalesce("unique_tokens", F.lit(0)))
    ratio = F.when(F.col("total_tokens") > 0, F.col("unique_tokens") / F.col("total_tokens")).otherwise(0.0)
    return out.select(*by, "total_tokens", "unique_tokens", ratio.alias("type_token_ratio"), "avg_unique")


def jaccard_best(queries: DataFrame, chunks: DataFrame, query_id: str, query: str, pos: str, text: str, probe: int = 3, counts: dict | None = None) -> DataFrame:
    """query_id, pos, shared, sim: the chunk of the highest token Jaccard with each query (ties: the least pos).

    A query that shares no token with any chunk gets the least pos and 0; a query without tokens has no row. Exact, without meeting every chunk that shares
    a common word. First the chunks that hold one of a query's `probe` rarest words are compared; the best of them is a floor t. A chunk that
    reaches t shares at least t * n of the query's n tokens, so it holds one of the n - ceil(t * n) + 1 rarest ones (rarity prefix), and has
    between t * n and n / t tokens (size bound). Only such chunks are compared then. counts: gets the pairs compared (compared).
    """
    sets = lambda df, i, t, n: df.select(F.col(i), F.array_distinct(tx.tokens(F.col(t))).alias("s")).withColumn(n, F.size("s"))
    q, c = written(sets(queries, query_id, query, "nq").filter("nq > 0").withColumnRenamed("s", "qs"), "query-sets"), written(sets(chunks, pos, text, "nc"), "chunk-sets")
    asked, held = q.select(query_id, "nq", F.explode("qs").alias("w")), c.select(pos, "nc", F.explode("s").alias("w"))
    df = held.join(asked.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # Words that no chunk holds are the rarest: they count in the prefix, and meet nothing.
    order = W.partitionBy(query_id).orderBy(F.coalesce("df", F.lit(0)), "w")
    ranked = written(asked.join(df, "w", "left").withColumn("i", F.row_number().over(order)).filter("df IS NOT NULL"), "query-words")

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(c.select(pos, "nc", "s"), pos).join(q, query_id).withColumn("shared", F.size(F.array_intersect("s", "qs")).cast("long"))
        return both.select(query_id, pos, "shared", (F.col("shared") / (F.col("nq") + F.col("nc") - F.col("shared"))).alias("sim"))

    nth = F.row_number().over(W.partitionBy(query_id).orderBy("i"))
    rare = ranked.withColumn("nth", nth).filter(F.col("nth") <= probe)
    first = written(compared(held.join(rare.select(query_id, "w"), "w").select(query_id, pos).distinct()), "jaccard-first")
    floor = ranked.select(query_id).distinct().join(first.groupBy(query_id).agg(F.max("sim").alias("floor")), query_id, "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)) - 1e-9)
    near = ranked.join(floor, query_id).filter(F.col("i") <= F.col("nq") - F.ceil(F.greatest(F.col("floor"), F.lit(0.0)) * F.col("nq")) + 1)
    sized = (F.col("nc") >= F.col("floor") * F.col("nq")) & (F.col("nc") * F.col("floor") <= F.col("nq"))
    pairs = held.join(near.select(query_id, "w", "nq", "floor"), "w").filter(sized).select(query_id, pos).distinct()
    every = first.unionByName(compared(pairs.join(first.select(query_id, pos), [query_id, pos], "left_anti")))
    if counts is not None:
        every = written(every, "jaccard-compared")
        counts["compared"] = every.count()
    best = every.withColumn("r", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("sim"), F.asc(pos)))).filter("r = 1").select(query_id, pos, "shared", "sim")
    none = q.join(ranked.select(query_id).distinct(), query_id, "left_anti").crossJoin(F.broadcast(c.agg(F.min(pos).alias(pos)))).filter(F.col(pos).isNotNull())
    return best.unionByName(none.select(query_id, pos, F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("sim")))


def jaccard_hit_rate(queries: DataFrame, chunks: DataFrame, query_id: str, query: str, pos: str, text: str, least: int = 2) -> DataFrame:
    """hit_rate over all queries (a hit shares `least` tokens with its best chunk), and the mean best similarity of queries with tokens."""
    best = jaccard_best(queries, chunks, query_id, query, pos, text)
    every = queries.select(query_id, (F.size(tx.tokens(F.col(query))) > 0).alias("asked")).join(best, query_id, "left")
    hit = (F.coalesce("shared", F.lit(0)) >= least).cast("double")
    return every.agg(F.count(F.lit(1)).alias("n_queries"), F.avg(hit).alias("hit_rate"), F.coalesce(F.avg(F.when(F.col("asked"), F.coalesce("sim", F.lit(0.0)))), F.lit(0.0)).alias("avg_top1_sim"))
