"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, langid, langmodel, minhash, packing, periodic, quality, repeats, sharding, tokencount, toxicity
from .common import read
from .oracle import ORACLE_SQL  # noqa: F401


def _remainder(column: str, by: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(sharding.shuffle_into_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), 8))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_digest(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _remainder("doc_id", 4) == 2)
    labels = read(spark, sf_dir, "labels").filter(_remainder("doc_id", 4) != 2)
    scorer = toxicity.learn(docs.filter(~F.col("held_out")), labels)
    return toxicity.score_texts(docs, scorer).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langmodel.score_corpus(read(spark, sf_dir, "documents"), held_out=_remainder("doc_id", 7) == 2)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})  # terms are added in no fixed order


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = htmltext.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(_remainder("doc_id", 3) != 1))
    named = docs.select("doc_id", "text", (_remainder("doc_id", 3) == 1).alias("held_out"))
    return langid.identify(named, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(periodic.find_runs(periodic.with_planted_runs(read(spark, sf_dir, "documents"))))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(repeats.find_repeats(read(spark, sf_dir, "documents")))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
