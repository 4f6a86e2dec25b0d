"""Retrieval report: builds the lexical index of a corpus, asks every query by four methods, and judges what each finds.

    python -m jobs.retrieval_report --documents DIR --embeddings DIR --queries DIR --out DIR [--config jobs/retrieval_report.json]

documents (Parquet: doc_id, source, text) and embeddings (vec_id, embedding) are the corpus, joined by number; queries (item_id, text) are asked by BM25, by vectors,
by the blend of both, and by the blend without stop words in the query. A query's vector is the one of its number; its expected source is that of the
document of its number.

Writes the index (DIR/index), the results in folders by method (DIR/results) and a summary by method (DIR/summary). A rerun replaces what it writes
anew, folder by folder, so it gives the same tables; methods of the results that a run doesn't make are left as they are.
"""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import HERE, command_session, load_config
from lexmill.operators import evaluate, hybrid, lexical
from lexmill.sources.work import scope

LOG = logging.getLogger("jobs.retrieval_report")
CONFIG = os.path.join(HERE, "retrieval_report.json")
DEFAULTS = {"k": 3, "alpha": 0.7, "relevant_from": 0.15}
RESULTS = "query_id long, rank int, pos long, score double, judged double, source string, expected string, relevant boolean, method string"


def read_results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(RESULTS).parquet(f"{out}/results")


def retrieval_report(spark: SparkSession, documents: str, embeddings: str, queries: str, out: str, config: dict | None = None) -> dict[str, int]:
    """One run; the counts of rows read and written. Work tables are deleted at its end."""
    with scope(spark):
        return _report(spark, documents, embeddings, queries, out, config)


def _report(spark: SparkSession, documents: str, embeddings: str, queries: str, out: str, config: dict | None) -> dict[str, int]:
    settings = DEFAULTS | (config or {})
    docs = spark.read.parquet(documents).select(F.col("doc_id").alias("pos"), "source", "text")
    vectors = spark.read.parquet(embeddings).select(F.col("vec_id").alias("pos"), "embedding")
    items = spark.read.parquet(queries).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    corpus = lexical.counted(hybrid.with_vectors(docs, vectors), "pos", "text", "embedding")
    asked = items.join(vectors.select(F.col("pos").alias("query_id"), F.col("embedding").alias("vector")), "query_id")

    lexical.save_index(lexical.index_of(corpus), f"{out}/index")
    index = lexical.load_index(spark, f"{out}/index")
    found = hybrid.retrieve_by_methods(corpus, asked, index, settings["k"], settings["alpha"])
    expected = docs.select(F.col("pos").alias("query_id"), F.col("source").alias("expected"))
    judged = hybrid.judge(found, docs, expected, settings["relevant_from"]).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in RESULTS.split(", ")))
    judged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(f"{out}/results")

    results = read_results(spark, out)
    summary = evaluate.method_hit_rate(results).join(results.filter("rank = 1").groupBy("method").agg(F.avg("score").alias("top_score")), "method")
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    counts = {"rows": index.docs.count(), "queries": asked.count(), "results": results.count()}
    lexical.forget_index(spark, index)
    LOG.info("read %d rows of %s and %d queries of %s, wrote %d results to %s", counts["rows"], documents, counts["queries"], queries, counts["results"], out)
    for r in spark.read.json(f"{out}/summary").orderBy("method").collect():  # one row a method
        LOG.info("%s: hit rate %.3f over %d queries, mean best score %.4f", r.method, r.hit_rate or 0.0, r.n_queries, r.top_score or 0.0)
    return counts


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "embeddings", "queries", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=CONFIG)
    a = p.parse_args(args)
    spark = command_session("retrieval_report")
    try:
        retrieval_report(spark, a.documents, a.embeddings, a.queries, a.out, load_config(a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
