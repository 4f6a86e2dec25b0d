"""The run log: stages with counts and times, and (an extension) latency windows over a growing log."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.work import written

RUNS = "run_id string, timestamp timestamp, total_ms double, stages array<struct<stage: int, name: string, elapsed_ms: double, rows: bigint, metrics: map<string, double>>>"


class StageLog:
    """The stages of one run. Each stage's table is written once, and its count and metrics are observed in the job that writes it."""

    def __init__(self, spark: SparkSession, run_id: str | None = None):
        self.spark, self.run_id = spark, run_id or uuid.uuid4().hex
        self.began, self.stages = time.time(), []

    def stage(self, name: str, df: DataFrame, **metrics: Column) -> DataFrame:
        """df, written; the log gets its number of rows and the metrics (aggregates over df)."""
        seen, began = Observation(f"{self.run_id}-{len(self.stages)}"), time.time()
        out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.cast("double").alias(n) for n, m in metrics.items())), f"stage-{name}")
        got = dict(seen.get)
        self.stages.append(Row(stage=len(self.stages) + 1, name=name, elapsed_ms=round((time.time() - began) * 1000, 1), rows=got.pop("rows"), metrics={n: float(v) for n, v in got.items() if v is not None}))
        return out

    def record(self) -> DataFrame:
        """One row: the run."""
        total = round((time.time() - self.began) * 1000, 1)
        return self.spark.createDataFrame([(self.run_id, total, self.stages)], RUNS.replace("timestamp timestamp, ", "")).withColumn("timestamp", F.current_timestamp()).select("run_id", "timestamp", "total_ms", "stages")

    def append(self, path: str) -> bool:
        """Adds the run to a log of JSON lines unless a run of its id is there; whether it did."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p) and not read_runs(self.spark, path).filter(F.col("run_id") == self.run_id).isEmpty():
            return False
        self.record().write.mode("append").json(path)
        return True


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).json(path)


def stage_rows(runs: DataFrame) -> DataFrame:
    """run_id, stage, name, elapsed_ms, rows, metrics: a row for each stage of each run."""
    return runs.select("run_id", F.inline("stages"))


def latency_windows(log: DataFrame, ts: str = "ts", value: str = "value", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and latencies per tumbling window; works on a stream (rows later than `late` are dropped) and on a table alike."""
    log = log.withWatermark(ts, late) if log.isStreaming else log
    out = log.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "avg_value", "min_value", "max_value")


def latency_summary(log: DataFrame, value: str = "value", by: str = "event_type") -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.percentile(value, 0.5).alias("median_value"))
