"""Encoders, chat calls and the stage log."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import models, pipeline
from lexmill.streaming import runlog

TEXTS = ["Red green, red!", "", None, "   ", "one two three 4 five_six", "word " * 900, "12 34"]


def by_hand(t, width):
    out = [0.0] * width
    for w in re.findall(r"(?<!\w)[a-z]{2,}(?!\w)", (t or "").lower()):
        h = hashlib.md5(w.encode()).hexdigest()
        out[int(h[:7], 16) % width] += 1 if int(h[7], 16) % 2 else -1
    n = sum(x * x for x in out) ** 0.5
    return [x / n if n else 0.0 for x in out]


def test_vectors_do_not_depend_on_batches(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").withColumn("vector", F.lit("clash"))
    want = {i: by_hand(t, 16) for i, t in enumerate(TEXTS)}
    for batch, parts in ((1, 1), (3, 2), (64, 5)):
        got = models.encode(df.repartition(parts), "text", models.hashing_encoder(16), 16, name="test-16", batch=batch)
        assert got.columns == ["i", "text", "vector"]
        rows = {r.i: r.vector for r in got.collect()}
        assert rows.keys() == want.keys() and all(rows[i] == pytest.approx(want[i]) for i in want)
    assert rows[1] == rows[2] == rows[3] == rows[6] == [0.0] * 16
    assert models.encode(df.limit(0), "text", models.hashing_encoder(16), 16).count() == 0


def test_encoder_gets_batches_of_cut_texts_and_loads_once(spark):
    def load():
        import numpy as np

        loads = [1]  # a second load would start anew

        def run(texts):
            loads[0] += 1
            return np.array([[len(t), len(texts), loads[0]] for t in texts], float)

        return run

    df = spark.createDataFrame([(i, "ab " * 1000) for i in range(10)], "i int, text string").coalesce(1)
    got = sorted((r.vector for r in models.encode(df, "text", load, 3, name="test-load", batch=4).collect()), key=lambda v: v[2] / v[0])
    # 1,999 characters of each text (cut at a blank), batches of 4, 4 and 2.
    assert [round(v[1] / v[0] * 1999) for v in got] == [4] * 8 + [2] * 2 and [round(v[2] / v[0] * 1999) for v in got] == [2] * 4 + [3] * 4 + [4] * 2
    wrong = models.encode(df, "text", models.hashing_encoder(5), 7, name="test-wrong")
    with pytest.raises(Exception, match="of width 7"):
        wrong.collect()


def test_a_failing_model_loses_no_row(spark):
    def flaky():
        """Fails on every message's first call, for good on 'bad', and by an answer without a text on 'odd'."""
        seen = {}

        def run(messages):
            said = messages[-1]["content"]
            seen[said] = seen.get(said, 0) + 1
            if said == "bad" or seen[said] == 1:
                raise TimeoutError("slow")
            return {"prompt_tokens": 1} if said == "odd" else {"text": f"{said}:{seen[said]}", "prompt_tokens": 2, "completion_tokens": None}

        return run

    message = F.array(F.struct(F.lit("user").alias("role"), F.col("t").alias("content")))
    df = spark.createDataFrame([(0, "hi"), (1, "hi"), (2, "bad"), (3, "odd"), (4, None), (5, "ho")], "i int, t string")
    df = df.withColumn("messages", F.when(F.col("t").isNotNull(), message)).withColumn("error", F.lit(1))
    out = models.call_model(df, flaky, name="test-flaky", retries=2, wait=0.0, partitions=2)
    got = {r.i: r for r in out.collect()}
    assert len(got) == 6 and "__key" not in out.columns
    assert got[0].response == got[1].response == "hi:2" and got[0].latency_ms == got[1].latency_ms  # asked once
    assert (got[0].attempts, got[0].prompt_tokens, got[0].completion_tokens, got[0].error) == (2, 2, 0, None)
    assert (got[2].response, got[2].error, got[2].attempts) == ("", "TimeoutError: slow", 3)
    assert got[3].error.startswith("KeyError") and got[3].attempts == 3
    assert (got[4].error, got[4].attempts) == ("no messages", 0) and got[5].response == "ho:2"
    assert {r.i: r.response for r in out.collect()} == {i: r.response for i, r in got.items()}  # not asked again
    assert models.call_model(df.limit(0), flaky, name="test-flaky").count() == 0


def test_stage_log(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "s", "red green", [1.0, 0.0]), (1, "s", "blue", [0.0, 1.0]), (2, "t", "red red", [1.0, 1.0])], "pos long, source string, text string, embedding array<double>")
    queries = spark.createDataFrame([(1, "the red"), (2, "blue"), (3, "fail")], "query_id long, query string")
    encode = lambda q: q.select("query_id", F.when(F.col("query") == "blue", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("vector"))

    def guard():
        def run(messages):
            said = messages[-1]["content"]
            if "fail" in said:
                raise RuntimeError("down")
            return {"text": "INSUFFICIENT CONTEXT" if "blue" in said.split("QUESTION:")[1] else "Red."}

        return run

    line = pipeline.AnswerPipeline(chunks, encode, lambda df: models.call_model(df, guard, name="test-guard", wait=0.0), k=2)
    log = runlog.StageLog(spark, "run-1")
    out = {r.query_id: r for r in line.run_logged(queries, log).collect()}
    assert out[1].response == "Red." and out[2].response.startswith("The documents") and out[3].error == "RuntimeError: down" and out[3].response == ""
    path = str(tmp_path / "log")
    assert log.append(path) and not log.append(path)
    other = runlog.StageLog(spark, "run-2")
    other.stage("only", queries)
    assert other.append(path)
    rows = {(r.run_id, r.stage): r for r in runlog.stage_rows(runlog.read_runs(spark, path)).collect()}
    assert len(rows) == 7 and [rows["run-1", i].name for i in range(1, 7)] == ["preprocess", "retrieve", "select", "prompt", "generate", "respond"]
    found = line.retrieve(queries)
    assert rows["run-1", 2].rows == found.count() == 6 and rows["run-1", 1].metrics["changed"] == 1.0
    assert [rows["run-1", i].rows for i in (1, 3, 4, 5, 6)] == [3] * 5
    assert rows["run-1", 5].metrics["failed"] == 1.0 and rows["run-1", 6].metrics["refused"] == 0.0 and all(r.elapsed_ms > 0 for r in rows.values())
    assert rows["run-1", 3].metrics["chunks"] == sum(r.chunks_used for r in pipeline.ctx.build_context(found, "ranking").collect())
    record = runlog.read_runs(spark, path).filter("run_id = 'run-1'").first()
    assert record.total_ms >= max(s.elapsed_ms for s in record.stages) and record.timestamp is not None
