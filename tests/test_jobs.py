"""The jobs: growing input, reruns, repeated batches, null and repeated rows, the command line."""
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import ingest, queries, retrieval_report
from jobs.common import load_config, stream_path
from lexmill.operators import hybrid
from lexmill.sources.work import work_dir
from tests.test_oracle import TABLES, rows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CONFIG = {"strategies": {"a": {"strategy": "fixed_size", "size": 40, "overlap": 10}}, "min_chars": 5}


def delivered(spark, folder, name, docs):
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{folder}/{name}")


def table(spark, chunks):
    """All chunks, without the number of their batch."""
    return sorted(map(tuple, ingest.read_chunks(spark, chunks).drop("batch").collect()), key=repr)


FIRST = [(1, "a", "x " * 60), (2, "b", "One. Two. Three. Four. Five. Six. Seven."), (3, None, "No source here. Really."), (None, "a", "no number at all"), (4, "b", ""), (5, "b", None), (6, "a", " tiny ")]
SECOND = [FIRST[0], FIRST[1], (2, "b", "A changed text. It is new."), (7, "c", "Something else. At last."), (7, "c", "Something else. At last.")]


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    docs, chunks, checkpoint = (str(tmp_path / n) for n in ("docs", "chunks", "checkpoint"))
    delivered(spark, docs, "one.parquet", FIRST)
    got = ingest.ingest(spark, f"{docs}/*.parquet", chunks, checkpoint, CONFIG)
    assert got["read"] == len(FIRST) and got["batches"] == 1 and got["documents"] == 4
    one = table(spark, chunks)
    assert {r.source for r in ingest.read_chunks(spark, chunks).collect()} == {"a", "b", None}
    # Nothing new: nothing is done.
    assert ingest.ingest(spark, f"{docs}/*.parquet", chunks, checkpoint, CONFIG)["batches"] == 0 and table(spark, chunks) == one
    delivered(spark, docs, "two.parquet", SECOND)
    got = ingest.ingest(spark, f"{docs}/*.parquet", chunks, checkpoint, CONFIG)
    assert got["read"] == len(SECOND) and got["documents"] == 2
    both = table(spark, chunks)
    assert set(one) < set(both) and len(both) == len(one) + 2
    # All at once gives the same chunks.
    ingest.ingest(spark, f"{docs}/*.parquet", str(tmp_path / "other"), str(tmp_path / "other-checkpoint"), CONFIG)
    assert table(spark, str(tmp_path / "other")) == both


def test_ingest_repeats_a_batch_that_was_not_committed(spark, tmp_path):
    docs, chunks, checkpoint = (str(tmp_path / n) for n in ("docs", "chunks", "checkpoint"))
    delivered(spark, docs, "one.parquet", FIRST)
    ingest.ingest(spark, f"{docs}/*.parquet", chunks, checkpoint, CONFIG)
    delivered(spark, docs, "two.parquet", SECOND)
    ingest.ingest(spark, f"{docs}/*.parquet", chunks, checkpoint, CONFIG)
    both = table(spark, chunks)
    # As if the run had died behind its write: the batch is in the plan, not among the finished ones.
    for name in ("1", ".1.crc"):
        os.remove(os.path.join(checkpoint, "commits", name))
    assert ingest.ingest(spark, f"{docs}/*.parquet", chunks, checkpoint, CONFIG)["read"] == len(SECOND)
    assert table(spark, chunks) == both


def test_ingest_chunks_by_hand(spark, tmp_path):
    docs, chunks = str(tmp_path / "docs"), str(tmp_path / "chunks")
    delivered(spark, docs, "one.parquet", [(1, "a", "".join(chr(97 + i % 26) for i in range(100))), (2, "b", "One. Two. Three. Four. Five. Six.")])
    ingest.ingest(spark, f"{docs}/*.parquet", chunks, str(tmp_path / "checkpoint"), CONFIG)
    by = {(r.doc_id, r.chunk_index): r for r in ingest.read_chunks(spark, chunks).collect()}
    text = "".join(chr(97 + i % 26) for i in range(100))
    assert [by[1, i].text for i in range(3)] == [text[0:40], text[30:70], text[60:100]] and (1, 3) not in by
    assert [by[2, i].text for i in range(2)] == ["One. Two. Three. Four. Five.", "Five. Six."]
    assert by[2, 1].chunk_id == "b__sentence_based__00001" and by[2, 1].word_count == 2


def test_config_and_paths(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"min_chars": 3}))
    assert load_config(str(path), ingest.DEFAULTS)["min_chars"] == 3 and load_config(ingest.CONFIG, ingest.DEFAULTS)["otherwise"]
    path.write_text(json.dumps({"min_char": 3}))
    with pytest.raises(ValueError):
        load_config(str(path), ingest.DEFAULTS)
    assert stream_path("/a/b.parquet") == "/a/b.parque[t]" and stream_path("/a/*.parquet") == "/a/*.parquet"


def test_unknown_strategy(spark, tmp_path):
    delivered(spark, str(tmp_path / "docs"), "one.parquet", FIRST)
    with pytest.raises(ValueError):
        ingest.chunk_documents(spark.read.parquet(str(tmp_path / "docs" / "one.parquet")).withColumn("delivery", F.lit("")), ingest.DEFAULTS | {"otherwise": {"strategy": "none"}})


def test_report_reruns_and_follows_its_input(spark, sf, tmp_path):
    """The second run over grown input replaces the first; a rerun changes nothing; both equal a run into an empty folder."""
    out, docs = str(tmp_path / "out"), str(tmp_path / "documents")
    paths = (f"{sf}/embeddings.parquet", f"{sf}/benchmark.parquet")
    every = spark.read.parquet(f"{sf}/documents.parquet")
    every.filter("doc_id % 2 = 0").coalesce(1).write.parquet(docs)
    read = lambda o: sorted(map(tuple, retrieval_report.read_results(spark, o).collect()), key=repr)
    tables = os.path.join(work_dir(spark).removeprefix("file://"), "lexmill-work")
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    first = retrieval_report.retrieval_report(spark, docs, *paths, out)
    assert set(os.listdir(tables)) == before  # no work table stays
    half = read(out)
    every.filter("doc_id % 2 = 1").coalesce(1).write.mode("append").parquet(docs)
    second = retrieval_report.retrieval_report(spark, docs, *paths, out)
    whole = read(out)
    assert second["rows"] > first["rows"] and whole != half
    assert retrieval_report.retrieval_report(spark, docs, *paths, out) == second and read(out) == whole
    retrieval_report.retrieval_report(spark, f"{sf}/documents.parquet", *paths, str(tmp_path / "other"))
    assert read(str(tmp_path / "other")) == whole
    summary = {r.method: r for r in spark.read.json(f"{out}/summary").collect()}
    assert set(summary) == set(hybrid.METHODS) and all(r.n_queries == second["queries"] for r in summary.values())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_twin(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())


def test_command_line(tmp_path, sf):
    out = tmp_path / "chunks"
    args = [sys.executable, "-m", "jobs.ingest", "--documents", f"{sf}/documents.parquet", "--chunks", str(out), "--checkpoint", str(tmp_path / "checkpoint")]
    done = subprocess.run(["timeout", "200", *args], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read 200 rows" in done.stderr and (out / "batch=0" / "_SUCCESS").exists()
