"""Matrix files, spreadsheets and graph bundles."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .integrity import table_digest


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def npy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row, values) of each two-dimensional .npy matrix that matches ``path``; a file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                m = np.atleast_2d(np.load(io.BytesIO(blob.as_py()), allow_pickle=False)).astype(np.float64)
                for at in range(0, len(m), 1024):
                    part = m[at:at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], ["row", "values"])

    return _files(spark, path).mapInArrow(run, "row bigint, values array<double>")


def npy_last_labels(spark: SparkSession, path: str, periods: int, units: int) -> DataFrame:
    """(idx, label): last period of integer labels that a .npy file holds flat, period after period; another length is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                last = np.load(io.BytesIO(blob.as_py()), allow_pickle=False).reshape(periods, units)[-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(units)), pa.array(last.astype(np.int64))], ["idx", "label"])

    return _files(spark, path).mapInArrow(run, "idx bigint, label bigint")


def npz_slice_mean(spark: SparkSession, path: str, name: str, rows: list[int], cols: list[int]) -> DataFrame:
    """(mean, n) of the cells (rows x cols) of one matrix of each .npz archive that matches ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                with np.load(io.BytesIO(blob.as_py()), allow_pickle=False) as z:
                    part = z[name][np.ix_(rows, cols)]
                yield pa.RecordBatch.from_arrays([pa.array([float(part.mean())]), pa.array([part.size])], ["mean", "n"])

    return _files(spark, path).mapInArrow(run, "mean double, n bigint")


def write_matrices(path: str, **matrices: np.ndarray) -> None:
    """Small driver matrices as one .npy or a compressed .npz, by the path's ending; written aside and moved into place."""
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "wb") as out:
        if path.endswith(".npz"):
            np.savez_compressed(out, **matrices)
        elif len(matrices) == 1:
            np.save(out, next(iter(matrices.values())), allow_pickle=False)
        else:
            raise ValueError("several matrices need a .npz path")
    os.replace(part, path)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(raw: bytes, member: str = "xl/worksheets/sheet1.xml") -> Iterator[list[str | None]]:
    """Rows of a workbook's sheet as text, codes as they are written, empty cells None."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        for row in ElementTree.fromstring(z.read(member)).iter(f"{_SHEET}row"):
            out: list[str | None] = []
            for cell in row.iter(f"{_SHEET}c"):
                place = 0
                for ch in cell.get("r", ""):
                    place = place * 26 + ord(ch) - 64 if ch.isalpha() else place
                out += [None] * (max(place, len(out) + 1) - len(out))
                value = cell.find(f"{_SHEET}v")
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                out[(place or len(out)) - 1] = text
            yield out


def workbook(spark: SparkSession, path: str, required: list[str], member: str = "xl/worksheets/sheet1.xml") -> DataFrame:
    """The required columns, as text, of the first sheet of each .xlsx file that matches ``path``; a missing one is an error.

    The first row holds the names. A workbook is one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                rows = sheet_rows(blob.as_py(), member)
                header = [(h or "").strip() for h in next(rows, [])]
                if missing := set(required) - set(header):
                    raise ValueError(f"missing columns {sorted(missing)}")
                at = [header.index(c) for c in required]
                held = [[r[k] if k < len(r) else None for k in at] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], pa.string()) for k in range(len(at))], required)

    return _files(spark, path).mapInArrow(run, ", ".join(f"`{c}` string" for c in required))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """A graph as two Parquet tables with the digest of both; returns the digest."""
    mark = graph_digest(nodes, edges)
    base = path.rstrip("/")
    nodes.write.parquet(f"{base}/nodes")
    edges.write.parquet(f"{base}/edges")
    nodes.sparkSession.createDataFrame([(mark,)], "digest string").coalesce(1).write.text(f"{base}/digest")
    return mark


def read_graph(spark: SparkSession, path: str, expected: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a bundle; contents that don't fit its digest, or the expected one, are an error."""
    base = path.rstrip("/")
    nodes, edges = spark.read.parquet(f"{base}/nodes"), spark.read.parquet(f"{base}/edges")
    held = spark.read.text(f"{base}/digest").first()[0]
    if graph_digest(nodes, edges) != held or expected not in (None, held):
        raise ValueError("graph differs from its digest")
    return nodes, edges


def graph_digest(nodes: DataFrame, edges: DataFrame) -> str:
    return ":".join(table_digest(t).first().digest for t in (nodes, edges))


def to_adjacency(edges: DataFrame) -> DataFrame:
    """(node, links): each node's neighbours with weights, in order, from undirected edges (src, dst, weight)."""
    two = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "weight").union(edges.where("src <> dst").select("dst", "src", "weight"))
    return two.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("to", "weight"))).alias("links"))


def from_adjacency(adjacency: DataFrame) -> DataFrame:
    """Back to edges (src, dst, weight), src at most dst."""
    return adjacency.select(F.col("node").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.to").alias("dst"), F.col("l.weight").alias("weight")).where("src <= dst")
