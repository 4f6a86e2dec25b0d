"""Work tables: results that are written once and read several times."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset an own one on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
        found = getattr(spark, "_lexmill_work", None)
        if not found:
            found = spark._lexmill_work = "file://" + tempfile.mkdtemp(prefix="lexmill-work-")
    return found.rstrip("/")


#: Paths made inside open scopes, innermost last.
_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Deletes the work tables that are made inside, at its end. For code that has written its own output by then: DataFrames that still read
    the tables fail afterwards."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the work folder that nothing else uses."""
    path = f"{work_dir(spark)}/lexmill-work/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the work folder and read back: it is computed once, and a lost executor costs no work before it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
