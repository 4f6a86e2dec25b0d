"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A CSV file with a header; read as Latin-1 if any line isn't valid UTF-8."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    reader = spark.read.option("header", True).option("encoding", "ISO-8859-1" if bad else "UTF-8")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """source, page_num (from 1), text of documents in binary files; extract gives the texts of a file's pages."""
    def run(frames):
        for f in frames:
            rows = [(p, i + 1, t) for p, b in zip(f["path"], f["content"]) for i, t in enumerate(extract(bytes(b)))]
            yield pd.DataFrame(rows, columns=["source", "page_num", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source string, page_num int, text string")


def tag_stripped(html):
    """A page's text for the page cleaners: tags become blanks."""
    return F.regexp_replace(html, r"<[^>]*>", " ")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def append_runs(df: DataFrame, path: str) -> None:
    """Adds run records to a log of JSON lines."""
    df.write.mode("append").json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """A chunk table in folders by source and strategy, which reads of either prune."""
    df.write.partitionBy("source", "strategy").parquet(path)


def write_index(df: DataFrame, path: str) -> None:
    """Vectors as (pos, embedding); read back with spark.read.parquet."""
    df.select("pos", "embedding").write.parquet(path)


def index_config(df: DataFrame, model: str, embedding: str = "embedding", index_type: str = "exact inner product") -> DataFrame:
    return df.agg(F.lit(model).alias("model"), F.max(F.size(embedding)).alias("dim"), F.count(F.lit(1)).alias("corpus_size"), F.lit(index_type).alias("index_type"))


def fetch(url: str, dest: str, timeout: int = 120) -> bool:
    """Downloads a file in small blocks unless it is there; true if it did. An unfinished download leaves nothing behind."""
    import os
    import urllib.request

    if os.path.exists(dest):
        return False
    part = dest + ".part"
    try:
        with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as out:
            while block := source.read(8192):
                out.write(block)
        os.replace(part, dest)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return True
