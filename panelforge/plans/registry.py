"""Register queries with their oracle; rounding is the same on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, cte: str = "", sql: str | None = None, doubles: str = "", digits: int = 6):
    """Decorator. ``sql`` is the oracle's SELECT after the CTEs; ``doubles`` names its columns to round."""

    def add(fn):
        QUERIES[name] = lambda spark, d: rounded(fn(spark, d), digits)
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            cols = doubles.split()
            body = sql
            if cols:
                swap = ", ".join(f"round({c} + 0.0, {digits}) + 0.0 AS {c}" for c in cols)
                body = f"SELECT * REPLACE ({swap}) FROM ({sql})"
            ORACLES[name] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in cte else ''}{cte.replace('RECURSIVE', '')} {body}" if cte else body
        return fn

    return add
