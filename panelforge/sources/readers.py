"""Readers: archives, delimited text, wide label files, JSON documents, inventories."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def single_member(names: list[str], suffix: str = ".csv", root_only: bool = False) -> str:
    """The one member of an archive with a suffix; none or several is an error."""
    found = [n for n in names if n.lower().endswith(suffix) and not (root_only and "/" in n.strip("/"))]
    if len(found) != 1:
        raise ValueError(f"expected one {suffix} member, found {len(found)}")
    return found[0]


def zip_csv(spark: SparkSession, path: str, schema: str, sep: str = ";", encoding: str = "utf-8") -> DataFrame:
    """Rows of the one CSV in each ZIP archive that matches ``path`` (any path Spark reads; an archive is one task's work).

    Columns are read as text by header name and cast to ``schema``; a missing column is an error.
    """
    import csv as csvlib

    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    text = ", ".join(f"`{n}` string" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(b.schema.get_field_index("content")):
                with zipfile.ZipFile(io.BytesIO(blob.as_py())) as z, z.open(single_member(z.namelist())) as raw:
                    rows = csvlib.reader(io.TextIOWrapper(raw, encoding, newline=""), delimiter=sep)
                    header = [h.strip().lstrip("﻿") for h in next(rows, [])]
                    if missing := set(names) - set(header):
                        raise ValueError(f"missing columns {sorted(missing)}")
                    place = [header.index(n) for n in names]
                    held: list[list] = []
                    for row in rows:
                        held.append([row[p] if p < len(row) and row[p] != "" else None for p in place])
                        if len(held) == 20_000:
                            yield _batch(held, names)
                            held = []
                    if held:
                        yield _batch(held, names)

    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, text)
    want = spark.createDataFrame([], schema).schema
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want.fields))


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header and an explicit schema; a row that doesn't fit is an error."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, mode="FAILFAST", enforceSchema=False)


def wide_labels(spark: SparkSession, path: str, unit: str) -> DataFrame:
    """(unit, period, label) of a file with a unit column and one integer column for each period."""
    wide = spark.read.csv(path, header=True)
    periods = [c for c in wide.columns if c != unit]
    return wide.unpivot([unit], periods, "period", "label").withColumn("label", F.col("label").cast("bigint"))


def last_labels(labels: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """(idx, unit, label) of the last period in the order of ``units`` (unit, idx); a missing or repeated unit is an error."""
    last = labels.join(labels.agg(F.max("period").alias("period")), "period", "left_semi").groupBy(unit).agg(F.count("*").alias("n"), F.first("label").alias("label"))
    ok = F.when(F.col("n") == 1, F.col("label")).otherwise(F.raise_error(F.lit("unit missing or repeated")).cast("bigint"))
    return units.join(last, unit, "left").select("idx", unit, ok.alias("label"))


def renamed(df: DataFrame, aliases: dict[str, str], required: list[str]) -> DataFrame:
    """Historic column names to canonical ones; a required column that is still missing is an error."""
    out = df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})
    if missing := set(required) - set(out.columns):
        raise ValueError(f"missing columns {sorted(missing)}")
    return out


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def staged_filter(df: DataFrame, stages: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows passing all stages, and a one-row count of those that pass each prefix of them (one pass)."""
    keep, counts = F.lit(True), [F.count("*").alias("rows")]
    for name, condition in stages:
        keep = keep & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(keep).alias(name))
    return df.where(keep), df.agg(*counts)


def audit(df: DataFrame) -> DataFrame:
    """(position, column, type, nulls, distinct_estimate): dataset introspection in one pass."""
    cols = [c for c, t in df.dtypes]
    row = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(cols)), *(F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias(f"d{k}") for k, c in enumerate(cols)))
    items = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{k}").alias("nulls"), F.col(f"d{k}").alias("distinct_estimate")) for k, (c, t) in enumerate(df.dtypes)))
    return row.select("_rows", F.explode(items).alias("x")).select(F.col("_rows").alias("rows"), "x.*")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of files; contents are hashed on the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def sections(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column matches, with the pattern's first group as ``section``."""
    re.compile(pattern)
    return df.withColumn("section", F.regexp_extract(column, pattern, 1)).where("section <> ''")
