"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next stage's
docs. All but the last return the columns of documents. Columns that documents hold beyond those used are carried along under their names; an empty
table gives an empty result in every stage; rows that repeat are judged one by one but by near-duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, langid, minhash, packing, quality
from lexmill.llm.common import discard, materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and the robust outlier test of their language and source. Null and empty texts, and those of under 50 words, go; a null
    language or source is a group of its own; a null doc_id is kept."""
    return quality.filter_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language can be told; the model learns from the labelled documents of the stage. Null texts and those without a letter go;
    a null or wrong language is set."""
    return langid.filter_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the least doc_id, of each class of near-duplicates. Null and wordless texts are classes of their own; of rows equal in doc_id and
    text one stays; a row without a doc_id stays only if it is nobody's duplicate."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts; n_chars follows. Null and empty texts stay; a text of which no word is left goes."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids and their checksum. A null text is empty: its piece is the end token."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Robust outliers, learned languages and token ids aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    name, stage = STAGES[-1]
    return materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
