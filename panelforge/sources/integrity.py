"""Integrity: digests, manifests, constraint checks, configuration."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): order- and partition-free digest of a table: sums of two row hashes."""
    cols = sorted(df.columns)
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("a"), F.sum(F.hash(*cols).cast("decimal(38,0)")).alias("b")).select("rows", F.sha2(F.concat_ws(":", "rows", "a", "b"), 256).alias("digest"))


def constraints(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, failing): rows that break each SQL condition (null breaks it), in one pass."""
    row = df.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"r{k}") for k, c in enumerate(rules.values())))
    items = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"r{k}").alias("failing")) for k, n in enumerate(rules)))
    return row.select(F.explode(items).alias("x")).select("x.*")


def require(df: DataFrame, condition: str, message: str) -> DataFrame:
    """``df`` unchanged; a row that breaks the condition is an error when the plan runs."""
    return df.where(F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def inventory_differences(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem): missing, unexpected or changed files of two inventories (name, sha256)."""
    x = actual.select("name", F.col("sha256").alias("a")).join(expected.select("name", F.col("sha256").alias("b")), "name", "full")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed")
    return x.select("name", problem.alias("problem")).where("problem is not null")


def merged(base: dict, override: dict) -> dict:
    """Deep merge of configuration mappings; lists and scalars are replaced."""
    return {k: merged(base[k], override[k]) if k in base and k in override and isinstance(base[k], dict) and isinstance(override[k], dict) else override.get(k, base.get(k)) for k in {**base, **override}}


def load_config(path: str, seen: tuple[str, ...] = ()) -> dict:
    """YAML or JSON configuration with ``extends`` (relative to the file); a cycle is an error."""
    path = os.path.abspath(path)
    if path in seen:
        raise ValueError("configuration extends itself")
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            own = json.load(f)
        else:
            import yaml

            own = yaml.safe_load(f) or {}
    parent = own.pop("extends", None)
    return merged(load_config(os.path.join(os.path.dirname(path), parent), (*seen, path)), own) if parent else own


def contained(root: str, relative: str) -> str:
    """A path inside a root; one that leaves it is an error."""
    full = os.path.realpath(os.path.join(root, relative))
    if not (full + os.sep).startswith(os.path.realpath(root) + os.sep):
        raise ValueError(f"path leaves {root}")
    return full


def manifest(config: dict, **extra) -> dict:
    """What a run depended on: configuration digest and versions."""
    import platform

    import numpy
    import pyarrow
    import pyspark

    return {"config_sha256": digest(config), "python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pyarrow": pyarrow.__version__, **extra}
