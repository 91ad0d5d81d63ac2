"""Every query against its SQL oracle, on the smallest tables; queries without one must return rows."""

import math
import os

import duckdb
import pytest

from panelforge.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(v)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert cols
        return
    res = db.execute(ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    place = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[k]) for k in place) for r in res.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True)), next((x, y) for x, y in zip(got, want, strict=True) if x != y)


def test_keys_of_oracles_are_queries():
    assert set(ORACLES) <= set(catalog.queries())


def test_consensus_covers_all_pairs_of_units(spark):
    from panelforge.plans import bindings

    runs = {}
    for r in bindings.runs_e(spark, SF).collect():
        runs.setdefault((r.family, r.run), {})[r.i] = r.label
    met = {}
    for (family, _), label in runs.items():
        ids = sorted(label)
        for k, i in enumerate(ids):
            for j in ids[k + 1:]:
                if label[i] == label[j]:
                    met[family, i, j] = met.get((family, i, j), 0) + 1
    each = sum(family == 0 for family, _ in runs)
    both = {}
    for (_, i, j), n in met.items():
        both[i, j] = both.get((i, j), 0) + n / each / 4
    found = catalog.queries()
    got = {(r.family, r.i, r.j): r.p for r in found["coassignment_pairs"](spark, SF).collect()}
    assert got.keys() == met.keys() and all(close(got[k], n / each) for k, n in met.items())
    got = {(r.i, r.j): r.p for r in found["family_balanced_consensus"](spark, SF).collect()}
    assert got.keys() == both.keys() and all(close(got[k], p) for k, p in both.items())
