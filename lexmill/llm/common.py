"""What the training-data operators share: tables, the shared folder, batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset an own one on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
        found = getattr(spark, "_lexmill_dir", None)
        if not found:
            found = spark._lexmill_dir = "file://" + tempfile.mkdtemp(prefix="lexmill-")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends there, so lost executors cost no upstream work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote."""
    path = getattr(df, "_lexmill_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def task_batches(batches, columns, rows: int = 1 << 14, size: int = 48 << 20):
    """Joins a task's Arrow batches into tables of at most so many rows or bytes (a single longer row stands alone)."""
    import pyarrow as pa

    held, n, b = [], 0, 0
    for batch in batches:
        if columns:
            batch = batch.select(columns)
        each = max(1, batch.nbytes // max(batch.num_rows, 1))
        at = 0
        while at < batch.num_rows:
            step = min(batch.num_rows - at, rows - n, max(1, (size - b) // each))
            held.append(batch.slice(at, step))
            n, b, at = n + step, b + step * each, at + step
            if n >= rows or b >= size:
                yield pa.Table.from_batches(held)
                held, n, b = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)
