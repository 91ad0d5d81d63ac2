"""Command line: ``python -m panelforge list | inspect TABLE | run QUERY... | verify DIR``.

A run writes each result as Parquet into a fresh folder with a manifest of what it depended on;
an existing result is an error, or is set aside with --force. verify recomputes the digests.
"""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession

from .plans import catalog
from .session import read_table
from .sources import integrity, readers, sinks


def _session() -> SparkSession:
    return SparkSession.builder.appName("panelforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(spark: SparkSession, data: str, out: str, names: list[str], force: bool = False) -> list[str]:
    """Run registered queries into out/<name>; returns the folders. The manifest holds rows and digest of each result."""
    found = catalog.queries()
    if unknown := [n for n in names if n not in found]:
        raise ValueError(f"unknown queries {unknown}")
    made = []
    for name in names:
        folder = integrity.contained(out, name)
        if os.path.exists(folder):
            if not force:
                raise FileExistsError(f"{folder} exists; use --force to set it aside")
            os.replace(folder, f"{folder}.{time.strftime('%Y%m%dT%H%M%S')}.{os.getpid()}")
        found[name](spark, data).write.parquet(f"file://{folder}/table")
        own = integrity.table_digest(spark.read.parquet(f"file://{folder}/table")).first()
        sinks.write_json(f"{folder}/manifest.json", integrity.manifest({"query": name, "data": data}, query=name, rows=own.rows, digest=own.digest))
        made.append(folder)
    return made


def verify(spark: SparkSession, out: str) -> list[str]:
    """Names of results whose table no longer has the digest of its manifest."""
    import json

    bad = []
    for name in sorted(os.listdir(out)):
        path = os.path.join(out, name, "manifest.json")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                held = json.load(f)
            if integrity.table_digest(spark.read.parquet(f"file://{os.path.abspath(out)}/{name}/table")).first().digest != held["digest"]:
                bad.append(name)
    return bad


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="panelforge")
    parts = parser.add_subparsers(dest="command", required=True)
    parts.add_parser("list", help="names of all queries")
    look = parts.add_parser("inspect", help="rows, columns, types and nulls of a table")
    look.add_argument("table")
    look.add_argument("--data", required=True)
    work = parts.add_parser("run", help="run queries into a folder")
    work.add_argument("query", nargs="+")
    work.add_argument("--data", required=True)
    work.add_argument("--out", required=True)
    work.add_argument("--force", action="store_true")
    check = parts.add_parser("verify", help="check results against their manifests")
    check.add_argument("out")
    a = parser.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = _session()
    if a.command == "inspect":
        rows = readers.audit(read_table(spark, a.data, a.table)).collect()
        print(sinks.markdown(rows, ["position", "column", "type", "nulls", "distinct_estimate"]), end="")
        return 0
    if a.command == "run":
        print("\n".join(run(spark, a.data, a.out, a.query, a.force)))
        return 0
    bad = verify(spark, a.out)
    print("\n".join(bad) if bad else "all results fit their manifests")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
