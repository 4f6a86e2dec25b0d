"""Makes the package importable in the workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per session, by Spark's own file server."""
    sc = spark.sparkContext
    if getattr(sc, "_lexmill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lexmill-"), "lexmill_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lexmill", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._lexmill_shipped = True
