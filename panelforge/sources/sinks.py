"""Sinks: deterministic text, atomic JSON, reports, resumable partitioned results."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_csv(df: DataFrame, path: str, order: list[str], compression: str = "none", files: int = 1) -> None:
    """Rows in order, doubles in their shortest exact form, empty text for nulls; range-partitioned into ``files`` files."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.csv(path, header=True, compression=compression, emptyValue="", nullValue="", mode="errorifexists")


def clean(value):
    """NaN and infinities to None, recursively."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    return value


def write_json(path: str, value) -> str:
    """Atomic UTF-8 JSON without NaN; returns the SHA-256 of the bytes."""
    raw = (json.dumps(clean(value), ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n").encode()
    handle, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "wb") as out:
        out.write(raw)
    os.replace(part, path)
    return hashlib.sha256(raw).hexdigest()


def records(df: DataFrame) -> DataFrame:
    """(json): a row as JSON with NaN as null."""
    cols = [F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def markdown(rows: Iterable, columns: list[str], digits: int = 4) -> str:
    """A small result (driver rows) as a Markdown table."""
    form = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(form(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def html_report(template: str, values: dict[str, str]) -> str:
    """Fill ``{{name}}`` places; one left unfilled is an error."""
    import html
    import re

    for k, v in values.items():
        template = template.replace("{{" + k + "}}", html.escape(str(v)))
    if left := re.findall(r"\{\{(\w+)\}\}", template):
        raise ValueError(f"unfilled places {left}")
    return template


def resumable(spark, base: str, keys: Iterable, job: Callable, context: str) -> list:
    """Run ``job(key) -> DataFrame`` into base/key=<key> for the keys whose results are not complete; returns those run.

    A result counts as complete if Spark's _SUCCESS and our _CONTEXT (a digest of the inputs and
    parameters) are there; another context is an error.
    """
    jvm = spark.sparkContext._jvm
    path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((base.rstrip("/"), *p)))
    fs = path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ran = []
    for k in keys:
        own = f"key={k}"
        if fs.exists(path(own, "_SUCCESS")):
            marks = [s.getPath().getName() for s in fs.listStatus(path(own)) if s.getPath().getName().startswith("_CONTEXT-")]
            if marks == [f"_CONTEXT-{context}"]:
                continue
            raise ValueError(f"{own} was made in another context")
        job(k).write.mode("overwrite").parquet(f"{base.rstrip('/')}/{own}")
        fs.create(path(own, f"_CONTEXT-{context}")).close()
        ran.append(k)
    return ran
