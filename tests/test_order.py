"""Sums of doubles that are rounded afterwards: terms in the order of the files."""

import duckdb
import pytest

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["fingerprint_digest", "multiset_equal"])
def test_rounded_sums_equal_sql_run_by_one_thread(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect(config={"threads": 1})
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = entry.queries()[name](spark, D)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_sums_are_those_of_the_files_order(spark, tmp_path):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from panelforge.plans import bindings as B

    draw, n = random.Random(1), 6000
    price, supplier, part = [round(draw.uniform(900, 100_000), 2) for _ in range(n)], [draw.randrange(3) for _ in range(n)], [draw.randrange(50) for _ in range(n)]
    day = pa.array([851990400000000] * n, pa.timestamp("us"))
    pq.write_table(pa.table({"l_suppkey": pa.array(supplier, pa.int64()), "l_partkey": pa.array(part, pa.int64()), "l_shipdate": day, "l_extendedprice": price}), tmp_path / "lineitem.parquet", row_group_size=500)
    pq.write_table(pa.table({"p_partkey": pa.array(range(50), pa.int64()), "p_type": ["LARGE"] * 50}), tmp_path / "part.parquet")
    want = dict.fromkeys(range(3), 0.0)
    for s, p in zip(supplier, price, strict=True):
        want[s] += p
    sums = lambda cells: {r.unit: r.value for r in cells(spark, str(tmp_path)).collect()}
    assert sums(B.cells) != want  # else the test shows nothing
    assert sums(B.cells_in_order) == want
