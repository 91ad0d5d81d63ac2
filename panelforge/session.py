"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_once = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each Spark application.

    Arrow batches to Python are held to 8 MB where the session still has Spark's
    default of 64 MB: texts are long, and workers share the executor's memory.
    """
    sc = spark.sparkContext
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":
        spark.conf.set(size, "8m")
    with _once:
        if sc.applicationId not in _shipped:
            _send(sc)
            _shipped.add(sc.applicationId)


def _send(sc: SparkContext) -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="panelforge-"), "panelforge.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("panelforge", os.path.relpath(full, root)))
    sc.addPyFile(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name; the path may be any that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
