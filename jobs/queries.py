"""The jobs as registered queries: each runs twice into one new folder and returns the whole output as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import ingest, retrieval_report
from jobs.common import load_config, work_folder
from lexmill.plans import catalog


def job1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = work_folder(spark, "ingest"), load_config(ingest.CONFIG, ingest.DEFAULTS)
    for _ in range(2):
        ingest.ingest(spark, f"{sf_dir}/documents.parquet", f"{folder}/chunks", f"{folder}/checkpoint", config)
    return ingest.read_chunks(spark, f"{folder}/chunks").drop("batch")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, config = work_folder(spark, "retrieval-report"), load_config(retrieval_report.CONFIG, retrieval_report.DEFAULTS)
    for _ in range(2):
        retrieval_report.retrieval_report(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings", "benchmark")), folder, config)
    return retrieval_report.read_results(spark, folder).withColumns({c: F.round(c, 6) for c in ("score", "judged")})


QUERIES = {f.__name__: f for f in (job1_ingest, job2_retrieval_report)}


def _windows(size: int, overlap: int, where: str) -> str:
    """Windows over each document of the clean table."""
    step = size - overlap
    cut = rf"regexp_replace(substring(text, CAST({step} * chunk_index + 1 AS BIGINT), {size}), '^\s+|\s+$', '', 'g')"
    return f"SELECT doc_id, delivery, source, chunk_index, {cut} AS text FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length(text) - {size}) / {step}.0)) AS BIGINT) + 1)) AS chunk_index FROM clean WHERE {where})"


_SENTENCES = f"""SELECT doc_id, delivery, source, chunk_index, array_to_string(s[4 * chunk_index + 1 : 4 * chunk_index + 5], ' ') AS text
  FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(s) - 5) / 4.0)) AS BIGINT) + 1)) AS chunk_index FROM (SELECT doc_id, delivery, source, {catalog._SENTENCES.format('text')} AS s FROM clean WHERE source IS NULL OR source NOT IN ('src0', 'src1')) WHERE len(s) > 0)"""

ORACLE_SQL = {
    "job1_ingest": rf"""
WITH new AS (SELECT DISTINCT doc_id, source, text, sha256(concat_ws(chr(1), coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), coalesce(text, ''))) AS delivery FROM documents),
clean AS (SELECT * FROM (SELECT doc_id, source, delivery, {catalog._PAGE} AS text FROM (SELECT *, {catalog._PAGE0.format('text')} AS t0 FROM new WHERE {catalog._STRIP.format('text')} <> '')) WHERE length(text) > 80),
cut AS (SELECT *, 'fixed_size' AS strategy FROM ({_windows(512, 64, "source = 'src0'")}) UNION ALL SELECT *, 'fixed_size' FROM ({_windows(1024, 128, "source = 'src1'")}) UNION ALL SELECT *, 'sentence_based' FROM ({_SENTENCES}))
SELECT doc_id, delivery, source || '__' || strategy || '__' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') AS chunk_id, CAST(chunk_index AS INT) AS chunk_index, text,
  CAST(length(text) AS INT) AS char_count, CAST(len({catalog._WORDS.format('text')}) AS INT) AS word_count, source, strategy FROM cut WHERE text <> ''""",
    "job2_retrieval_report": f"WITH {catalog._METHODS}, {catalog._JUDGE} SELECT method, query_id, CAST(rank AS INT) AS rank, pos, round(score, 6) AS score, round(judged, 6) AS judged, source, expected, relevant FROM judged",
}
