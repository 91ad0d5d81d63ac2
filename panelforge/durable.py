"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, set here only if unset and all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is None:
            return
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: nothing is left to clean with
        pass


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, never a replay of the
    plan, and pins values that would differ between two runs of a stage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelforge/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of stashed tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_stash_path", None):
            _remove(df.sparkSession, path)


def settle(result: DataFrame, *frames: DataFrame) -> DataFrame:
    """Stash a result and delete the stashed tables it was made from.

    The stashed result itself stays until the program ends: plans that the caller
    derives from it read its files at any later time.
    """
    out = stash(result)
    release(*frames)
    return out


def _united(edges: DataFrame) -> DataFrame:
    """(node, comp) of a small edge list (u, v), by union-find in one task on an executor."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        form = None

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            form = batch.column(0).type
            plain = lambda v: tuple(v.values()) if isinstance(v, dict) else v
            for x, y in zip(*(map(plain, batch.column(k).to_pylist()) for k in (0, 1)), strict=True):
                x, y = find(root.setdefault(x, x) if x not in root else x), find(root.setdefault(y, y) if y not in root else y)
                root[max(x, y)] = min(x, y)
        if form is not None:
            back = (lambda v: dict(zip((f.name for f in form), v, strict=True))) if pa.types.is_struct(form) else (lambda v: v)
            yield pa.RecordBatch.from_arrays([pa.array([back(x) for x in root], form), pa.array([back(find(x)) for x in root], form)], ["node", "comp"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, comp {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b", *, few: int = 0) -> DataFrame:
    """Connected components of an undirected edge list: (node, comp), comp the least node.

    Up to ``few`` edges, counted first, are united in one task; beyond, as follows.

    Alternating large-star and small-star steps; every step is a grouped minimum
    (combined before the shuffle) and a join of edges with their nodes' minima. The
    minima are written first: AQE splits a hot key only where both sides of a join are
    bare shuffles, not aggregates. Rounds are stashed; the loop ends when all
    edges are stars about their least node. Nodes without edges are not listed.
    """
    e = stash(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    if few and e.count() <= few:
        return settle(_united(e), e)
    while True:
        # done when every edge hangs a node on a root: no node hangs on two, no root hangs on another
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
        node = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("root").alias("root"))
        if not node.agg(F.max(F.when((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("root") > 0)), 1).otherwise(0))).first()[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stash(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lowest = stash(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step = stash(small)
        release(e, least, large, lowest)
        e = step
    star = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return settle(star.union(roots), e)
