"""Queries against their SQL on tables whose rows are repeated under shifted keys: every measured value is tied."""

import os

import duckdb
import pytest

from panelforge.plans import catalog

from .test_catalog import SF, close, plain

KEYS = {"supplier": ["s_suppkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}
COPIES, SHIFT = 3, 1_000_000


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Folder of the tables, three of them repeated, and a connection that sees them."""
    folder, db = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        if name in KEYS:
            moved = ", ".join(f"{k} + c * {SHIFT} AS {k}" for k in KEYS[name])
            db.execute(f"COPY (SELECT * EXCLUDE (c) REPLACE ({moved}) FROM range({COPIES}) r(c), '{SF}/{f}') TO '{folder}/{f}' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{f}", folder / f)
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{f}'")
    return str(folder), db


def same_as_sql(spark, copies, name):
    folder, db = copies
    df = catalog.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = db.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})")
    want = sorted((tuple(plain(v) for v in r) for r in res.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True)), next((x, y) for x, y in zip(got, want, strict=True) if x != y)


def test_kruskal_h_of_copies(spark, copies):
    same_as_sql(spark, copies, "kruskal_h")


def test_kruskal_within_region_of_copies(spark, copies):
    same_as_sql(spark, copies, "kruskal_within_region")


def test_job_external_validation_of_copies(spark, copies):
    same_as_sql(spark, copies, "job_external_validation")


def test_merge_omnibus_ranks_equal_units_equally(spark, copies, tmp_path):
    from panelforge.plans import bindings

    folder, db = copies
    for f in os.listdir(folder):
        if f != "lineitem.parquet":
            os.symlink(os.path.realpath(f"{folder}/{f}"), tmp_path / f)
    # rows in another order for each copy: the same prices are added up in another order
    db.execute(f"COPY (SELECT * FROM lineitem ORDER BY hash(l_orderkey, l_linenumber)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    wages = {}
    for r in bindings.suppliers(spark, str(tmp_path)).collect():
        wages.setdefault(r.unit % SHIFT, set()).add(r.wage)
    assert len(wages) == 10 and all(len(v) == 1 for v in wages.values())


def test_exact_sum_takes_any_doubles(spark):
    from panelforge.plans.bindings import exact_sum

    one = lambda *v: spark.createDataFrame([(x,) for x in v], "x double").agg(exact_sum("x").alias("s")).first().s
    assert one(0.1, 0.2, None, 0.3) == 0.6
    assert one(0.125, 1e300) == 1e300 and one(0.125, 0.25) == 0.375
    assert one(None) is None and one(float("nan"), 1.0) != one(1.0)


def test_both_sides_of_lineage_read_one_written_panel(spark):
    from panelforge.plans.catalog_relational import _lineage

    cur, off = _lineage(spark, SF)
    assert set(cur.inputFiles()) == set(off.inputFiles())
    assert not any("lineitem" in f for f in cur.inputFiles())
