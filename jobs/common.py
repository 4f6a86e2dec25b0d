"""What the jobs share: config files, log, the session of a command line."""

from __future__ import annotations

import json
import logging
import os
import sys
import tempfile
import uuid

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def load_config(path: str, known: dict) -> dict:
    """The settings of a JSON file over the defaults; a name that isn't known is an error."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    if unknown := set(given) - set(known):
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return known | given


def command_session(name: str) -> SparkSession:
    """The session of a command line; whatever spark-submit was given holds."""
    root = os.path.dirname(HERE)
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    from lexmill.plans.ship import ship

    ship(spark)
    return spark


def stream_path(path: str) -> str:
    """A path for a file stream that may name one file as well as a folder: as a pattern it matches both."""
    return path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a registered query under spark.checkpoint.dir; where that is unset an own one on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder on a cluster")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-jobs-")
    return f"{found.rstrip('/')}/lexmill-jobs/{name}-{uuid.uuid4().hex}"
