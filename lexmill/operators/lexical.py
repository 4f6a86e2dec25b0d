"""BM25 over many queries at once: postings, term statistics, scores.

Postings are counted inside each row (counted()): no token is shuffled. A query of an index touches only the postings of its terms, by an equi-join on the
term; scores are partial sums per (query, row). Many queries over all rows are better scored row by row: see hybrid.ranked().

A saved index (save_index, load_index) holds the postings in blocks: one row for each term and range of `block_rows` numbers of
rows, with the term's postings there and the highest part that any of them can add to a score. The rows are bucketed by term and
salt (the block's number modulo `salts`, so that a term that is everywhere fills many buckets). A join with the terms of queries moves no posting.
top k over a saved index skips the blocks that can't reach the k-th score: see bm25_topk_blocks().
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.work import new_path, written

K1, B = 1.5, 0.75

#: Bytes of a query side up to which it is broadcast.
SMALL_SIDE = 64 << 20


def fits(df: DataFrame, limit: int = SMALL_SIDE) -> bool:
    """Whether the measured size of df (ids and arrays of doubles) is within limit."""
    width = sum((F.size(c) * 8 if t.startswith("array") else F.lit(16) for c, t in df.dtypes), F.lit(16))
    return (df.agg(F.sum(width)).first()[0] or 0) <= limit


def small_side(df: DataFrame, limit: int = SMALL_SIDE) -> DataFrame:
    """df (ids and arrays of doubles), marked for broadcast if its measured size is within limit, else as it is."""
    return F.broadcast(df) if fits(df, limit) else df


@dataclass
class LexicalIndex:
    tf: DataFrame  # pos, term, tf, dl
    docs: DataFrame  # pos, dl (rows without tokens included)
    terms: DataFrame  # term, df, idf
    stats: DataFrame  # n, avgdl: one row
    blocks: DataFrame | None = None  # of a saved index: term, salt, block, held, weight, postings (pos, tf, dl)
    salts: int = 0
    names: tuple[str, ...] = ()  # of the tables that the session knows it by


def counted(df: DataFrame, pos: str = "pos", text: str = "text", *more: str) -> DataFrame:
    """pos, dl, words (array of term, tf) and more columns, written: texts are cut into tokens once."""
    toks = df.select(F.col(pos).alias("pos"), tx.tokens(F.col(text)).alias("_t"), *more)
    return written(toks.select("pos", F.size("_t").alias("dl"), tx.term_counts(F.col("_t")).alias("words"), *more), "term-counts")


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def _idf(df_of: DataFrame, stats: DataFrame) -> DataFrame:
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df_of.crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"))


def _weight(k1: float, b: float, avgdl):
    """The part of a posting's score that is its own: more occurrences in a shorter text weigh more."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))


def build_index(df: DataFrame, pos: str = "pos", text: str = "text") -> LexicalIndex:
    toks = df.select(F.col(pos).alias("pos"), tx.tokens(F.col(text)).alias("t"))
    return index_of(toks.select("pos", F.size("t").alias("dl"), tx.term_counts(F.col("t")).alias("words")))


def index_of(rows: DataFrame) -> LexicalIndex:
    """The index of rows as counted() has them."""
    docs = rows.select("pos", "dl")
    tf = rows.select("pos", "dl", F.inline("words")).select("pos", "term", "dl", "tf")
    stats = _stats(docs)
    return LexicalIndex(tf, docs, _idf(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats), stats)


#: Rows whose numbers share a block; places over which the blocks of a term are dealt; tokens for each bucket, and the most buckets.
BLOCK_ROWS, SALTS, BUCKET_TOKENS, MOST_BUCKETS = 128, 16, 4 << 20, 1 << 16
_BLOCK_SCHEMA = "term string, salt int, block bigint, held bigint, weight double, postings array<struct<pos: bigint, tf: bigint, dl: int>>"
_TERM_SCHEMA = "term string, df bigint, idf double"


def _bucketed(df: DataFrame, path: str, buckets: int, by: list[str], order: list[str]) -> None:
    """Writes df, which lies in its buckets, to an explicit path, one file for each bucket, under a table name that is given up at once."""
    name = f"lexmill_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *by).sortBy(*order).option("path", path).mode("overwrite").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay


def _as_table(spark: SparkSession, path: str, schema: str, name: str, buckets: int, by: list[str], order: list[str]) -> DataFrame:
    quoted = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{quoted}'")
    return spark.table(name)


def save_index(index: LexicalIndex, path: str, block_rows: int = BLOCK_ROWS, buckets: int | None = None, salts: int = SALTS, k1: float = K1, b: float = B) -> None:
    """Writes an index (pos: integers) to a folder, which is replaced. A posting's row number gives its block, so a block of a term is at most block_rows
    postings; k1 and b give a block's highest weight. buckets: by default one for each BUCKET_TOKENS tokens."""
    spark = index.tf.sparkSession
    index.docs.select(F.col("pos").cast("long").alias("pos"), "dl").write.mode("overwrite").parquet(f"{path}/docs")
    stats = _stats(spark.read.parquet(f"{path}/docs"))
    n, avgdl = stats.first()
    if buckets is None:
        buckets = int(min(MOST_BUCKETS, max(8, n * avgdl // BUCKET_TOKENS)))
    # Postings are dealt once, by what buckets them; the blocks of a bucket are made where it lies.
    block = F.floor(F.col("pos") / block_rows)
    dealt = index.tf.select("term", F.pmod(block, F.lit(salts)).cast("int").alias("salt"), F.col("pos").cast("long").alias("pos"), "tf", "dl").repartition(buckets, "term", "salt")
    rows = dealt.withColumn("block", block).groupBy("term", "salt", "block").agg(
        F.count(F.lit(1)).alias("held"), F.max(_weight(k1, b, F.lit(avgdl))).alias("weight"), F.array_sort(F.collect_list(F.struct("pos", "tf", "dl"))).alias("postings")
    )
    _bucketed(rows, f"{path}/blocks", buckets, ["term", "salt"], ["term", "salt", "block"])
    df_of = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("held").alias("df"))
    _bucketed(_idf(df_of, stats).repartition(buckets, "term"), f"{path}/terms", buckets, ["term"], ["term"])
    shape = (F.lit(x).alias(c) for c, x in (("block_rows", block_rows), ("buckets", buckets), ("salts", salts)))
    stats.select("n", "avgdl", *shape).write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    """The index in a folder. Its tables are known to the session under new names, so that Spark sees their buckets."""
    stats = spark.read.parquet(f"{path}/stats")
    shape = stats.first()
    names = tuple(f"lexmill_{uuid.uuid4().hex}" for _ in range(2))
    blocks = _as_table(spark, f"{path}/blocks", _BLOCK_SCHEMA, names[0], shape.buckets, ["term", "salt"], ["term", "salt", "block"])
    terms = _as_table(spark, f"{path}/terms", _TERM_SCHEMA, names[1], shape.buckets, ["term"], ["term"])
    tf = blocks.select("term", F.inline("postings")).select("pos", "term", "dl", "tf")
    return LexicalIndex(tf, spark.read.parquet(f"{path}/docs"), terms, stats.select("n", "avgdl"), blocks, shape.salts, names)


def forget_index(spark: SparkSession, index: LexicalIndex) -> None:
    """Gives up the table names of a loaded index; its files stay."""
    for name in index.names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def saved_index(df: DataFrame, pos: str = "pos", text: str = "text", **shape) -> LexicalIndex:
    """An index that is built once, saved in the work folder and read from there."""
    path = new_path(df.sparkSession, "index")
    save_index(build_index(df, pos, text), path, **shape)
    return load_index(df.sparkSession, path)


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, term, qf: a repeated term counts as often as it stands."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tx.tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def _asked(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """query_id, term, qf, idf, and every salt: what meets the blocks of a saved index by its buckets."""
    return terms.join(index.terms, "term").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(index.salts - 1))))


def bm25_matches(index: LexicalIndex, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, pos, score of the rows that hold a query term."""
    if index.blocks is None:
        met = index.tf.join(terms.join(index.terms, "term"), "term")
    else:
        met = index.blocks.join(_asked(index, terms), ["term", "salt"]).select("query_id", "idf", "qf", F.inline("postings"))
    return _summed(met, index, k1, b)


def _summed(met: DataFrame, index: LexicalIndex, k1: float, b: float) -> DataFrame:
    part = F.col("idf") * F.col("qf") * _weight(k1, b, F.col("avgdl"))
    # Rounded far below what matters, so that equal rows tie whatever the order in which terms were added.
    return met.crossJoin(F.broadcast(index.stats)).groupBy("query_id", "pos").agg(F.round(F.sum(part), 10).alias("score"))


def bm25_topk_blocks(index: LexicalIndex, terms: DataFrame, k: int = 5, probe: int = 4, counts: dict | None = None) -> DataFrame:
    """query_id, pos, score: the k best matches of each query over an index saved with K1 and B, exactly, without scoring every posting.

    The most that a block can add for a query is the sum of its terms' highest weights there. First the `probe` * k best blocks by that bound are scored;
    the k-th score found there is a floor that the k-th score over all blocks reaches. Then only blocks whose bound reaches the floor are
    scored. counts: gets the postings of the query terms (all) and those scored at the end (scored).
    """
    asked = written(_asked(index, terms), "query-terms")
    bound = F.sum(F.col("idf") * F.col("qf") * F.col("weight")).alias("bound")
    bounds = written(index.blocks.drop("postings").join(asked, ["term", "salt"]).groupBy("query_id", "block").agg(bound, F.sum("held").alias("held")), "block-bounds")

    def scored(chosen: DataFrame) -> DataFrame:
        want = chosen.select("query_id", "block", F.pmod("block", F.lit(index.salts)).cast("int").alias("salt")).join(asked, ["query_id", "salt"])
        return _summed(index.blocks.join(want, ["term", "salt", "block"]).select("query_id", "idf", "qf", F.inline("postings")), index, K1, B)

    best = top_k(bounds, probe * k, score="bound", tie="block")
    floor = top_k(scored(best), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("floor"))
    # With under k matches in the best blocks nothing can be skipped. Scores are rounded sums, hence the slack.
    reach = F.col("bound") >= F.when(F.col("found") >= k, F.col("floor") - 1e-6).otherwise(F.lit(0.0))
    chosen = written(bounds.join(floor, "query_id").filter(reach).select("query_id", "block", "held"), "blocks-chosen")
    if counts is not None:
        counts["all"], counts["scored"] = (d.agg(F.sum("held")).first()[0] or 0 for d in (bounds, chosen))
    return top_k(scored(chosen), k).select("query_id", "pos", "score")


def bm25_scores(index: LexicalIndex, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, pos, score of every row for every query; rows without a match score 0."""
    ids = queries.select(F.col(query_id).alias("query_id"))
    got = bm25_matches(index, query_terms(queries, query_id, query))
    return index.docs.select("pos").crossJoin(small_side(ids)).join(got, ["query_id", "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def top_k(scores: DataFrame, k: int, by: list[str] | None = None, score: str = "score", tie: str = "pos") -> DataFrame:
    """The k rows of the highest score of each group, ranked from 1; ties by the least `tie`."""
    w = W.partitionBy(*(by or ["query_id"])).orderBy(F.desc(score), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_topk(index: LexicalIndex, queries: DataFrame, k: int = 5, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Top k of each query. Rows without a match can only fill places behind all matches, so the k least pos of them
    (among the first k + matches, of which k suffice) are enough: no query meets every row."""
    terms = query_terms(queries, query_id, query)
    got = top_k(bm25_matches(index, terms), k).select("query_id", "pos", "score") if index.blocks is None else written(bm25_topk_blocks(index, terms, k), "top-k")
    first = index.docs.select("pos").orderBy("pos").limit(2 * k)
    fill = first.crossJoin(queries.select(F.col(query_id).alias("query_id"))).join(got, ["query_id", "pos"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(got.unionByName(fill), k)
