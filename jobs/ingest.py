"""Incremental ingestion: new document files are cleaned, chunked and added to the chunk table that retrieval reads.

    python -m jobs.ingest --documents DIR --chunks DIR --checkpoint DIR [--config jobs/ingest.json]

The documents (Parquet: doc_id, source, text) are a file stream: a run takes the files that no earlier run has taken, and ends. Each source has its
chunking strategy and parameters in the config. A document that was delivered before (equal in doc_id and text) is passed over; a changed text under
the same doc_id is a delivery of its own. Cleaned texts of at most `min_chars` characters give no chunk.

The chunk table lies in folders by batch, source and strategy. A batch that is repeated after a failure has the same number and replaces its own folder,
so a rerun gives the same table. Checkpoint and table belong together.
"""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import HERE, command_session, load_config, stream_path
from lexmill.functions import text as tx
from lexmill.operators import chunk, clean

LOG = logging.getLogger("jobs.ingest")
CONFIG = os.path.join(HERE, "ingest.json")
DEFAULTS = {"strategies": {}, "otherwise": {"strategy": "sentence_based"}, "min_chars": 80, "files_per_batch": 1000}
SCHEMA = "doc_id long, delivery string, chunk_id string, chunk_index int, text string, char_count int, word_count int, batch long, source string, strategy string"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of all batches."""
    return spark.read.schema(SCHEMA).parquet(path)


def delivery(doc_id, source, text):
    """What tells deliveries apart."""
    parts = (F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, source, text))
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def chunk_documents(docs: DataFrame, settings: dict) -> DataFrame:
    """Chunks of documents (doc_id, source, text, delivery), each source by its own strategy."""
    pages = clean.clean_pages(docs, least=settings["min_chars"])
    named = settings["strategies"]
    mine = {s: F.col("source").eqNullSafe(F.lit(s)) for s in named}
    rest = F.lit(True)
    for c in mine.values():
        rest = rest & ~c
    out = None
    for rule, where in [*((named[s], mine[s]) for s in named), (settings["otherwise"], rest)]:
        options = dict(rule)
        strategy = options.pop("strategy")
        if strategy not in chunk.STRATEGIES:
            raise ValueError(f"no such strategy: {strategy}")
        cut = chunk.STRATEGIES[strategy](pages.filter(where), **options)
        cut = tx.with_once(cut, "text", tx.strip(F.col("text"))).filter(F.length("text") > 0)
        part = cut.select(
            F.col("doc_id").cast("long").alias("doc_id"), "delivery", F.format_string("%s__%s__%05d", "source", F.lit(strategy), "chunk_index").alias("chunk_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "text",
            F.length("text").alias("char_count"), F.size(tx.words(F.col("text"))).alias("word_count"), "source", F.lit(strategy).alias("strategy"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def ingest(spark: SparkSession, documents: str, chunks: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """One run over what is new; the counts of batches, of rows read, and of documents and chunks written."""
    settings = DEFAULTS | (config or {})
    total = {"batches": 0, "read": 0, "documents": 0, "chunks": 0}

    def take(batch: DataFrame, number: int) -> None:
        key = delivery(F.col("doc_id"), F.col("source"), F.col("text"))
        # The source is part of the key, so that each strategy's filter on it reaches the scan.
        new = batch.withColumn("delivery", key).dropDuplicates(["source", "delivery"])
        if number:  # earlier batches only: a repeated batch doesn't meet itself
            new = new.join(read_chunks(batch.sparkSession, chunks).filter(F.col("batch") < number).select("delivery"), "delivery", "left_anti")
        folder = f"{chunks}/batch={number}"
        chunk_documents(new, settings).write.mode("overwrite").partitionBy("source", "strategy").parquet(folder)
        wrote = read_chunks(batch.sparkSession, chunks).filter(F.col("batch") == number).agg(F.count_distinct("delivery").alias("documents"), F.count(F.lit(1)).alias("chunks")).first()
        got = {"batches": 1, "read": batch.count(), **wrote.asDict()}
        for k, v in got.items():
            total[k] += v
        LOG.info("batch %d: read %d rows from %s, wrote %d chunks of %d new documents to %s", number, got["read"], documents, got["chunks"], got["documents"], folder)

    schema = spark.read.parquet(documents).select("doc_id", "source", "text").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(stream_path(documents))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%d batches, %d rows read, %d chunks of %d documents written", total["batches"], total["read"], total["chunks"], total["documents"])
    return total


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "chunks", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=CONFIG)
    a = p.parse_args(args)
    spark = command_session("ingest")
    try:
        ingest(spark, a.documents, a.chunks, a.checkpoint, load_config(a.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
