"""How the engine's concepts sit on the driver's tables.

P: supplier x half-year x part type panel of summed prices (six types, ten
half-years 1996-2000). E: embeddings with their label as reference partition, and
twelve deterministic runs (sign bits of three dimensions each) in four families.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators.pairs import knn
from ..session import read_table

CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SELECTED = [c for c in CATEGORIES if c != "PROMO"]
PERIODS = list(range(10))
K = 5
RUNS, FAMILIES = 12, 4


def raw_panel(spark: SparkSession, d: str, *extra: Column) -> DataFrame:
    """Raw long rows (unit, t, category, value), one for each line; ``extra`` columns of the lines come after."""
    lines = read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_extendedprice", *extra)
    names = lines.columns[4:]
    parts = read_table(spark, d, "part").select("p_partkey", "p_type")
    lines = lines.where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp")))
    t = ((F.year("l_shipdate") - 1996) * 2 + F.when(F.month("l_shipdate") > 6, 1).otherwise(0)).cast("int")
    # hashed, not sorted: parts are far fewer than lines
    return lines.join(parts.hint("shuffle_hash"), lines.l_partkey == parts.p_partkey).select(F.col("l_suppkey").alias("unit"), t.alias("t"), F.col("p_type").alias("category"), F.col("l_extendedprice").alias("value"), *names)


def cells(spark: SparkSession, d: str) -> DataFrame:
    return raw_panel(spark, d).groupBy("unit", "t", "category").agg(F.sum("value").alias("value"))


def cells_in_order(spark: SparkSession, d: str) -> DataFrame:
    """``cells`` whose doubles are added one by one as they stand in the files: the same sums however rows are dealt.

    For values that are rounded afterwards, where the last bit of a sum decides. The lines of a cell are held in one row.
    """
    raw = raw_panel(spark, d, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    held = raw.groupBy("unit", "t", "category").agg(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value")))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x["value"])
    return held.select("unit", "t", "category", F.when(F.size("x") > 0, total).alias("value"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the complete units, in one scan: cells are unique, so a unit's cells are counted over it."""
    return P.complete_rows(cells(spark, d), CATEGORIES, len(PERIODS))


def points_p(spark: SparkSession, d: str) -> DataFrame:
    """(g = period, i = unit, vec)."""
    return P.features(panel(spark, d)).select(F.col("t").alias("g"), F.col("unit").alias("i"), "vec")


def near_p(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return knn(points_p(spark, d), k, group="g", key="i", vec="vec")


def points_e(spark: SparkSession, d: str) -> DataFrame:
    """(g = 0, i = vec_id, vec, label)."""
    return read_table(spark, d, "embeddings").select(F.lit(0).alias("g"), F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("bigint").alias("label"))


def near_e(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return knn(points_e(spark, d), k, group="g", key="i", vec="vec")


def runs_e(spark: SparkSession, d: str) -> DataFrame:
    """(run, family, i, label): run r labels by the signs of dimensions 3r, 3r + 1, 3r + 2."""
    e = points_e(spark, d).select("i", "vec", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"))
    bit = lambda k: F.when(F.element_at("vec", (F.col("run") * 3 + k + 1).cast("int")) > 0, 1 << (2 - k)).otherwise(0)
    return e.select("run", (F.col("run") % FAMILIES).alias("family"), "i", (bit(0) + bit(1) + bit(2)).cast("bigint").alias("label"))


def labels_by_t(spark: SparkSession, d: str) -> DataFrame:
    """(t, i, label): each unit's largest category in each period (its place in name order)."""
    c = panel(spark, d).selectExpr("unit as i", "t", "category", "row_number() over (partition by unit, t order by value desc, category) as place").where("place = 1")
    return c.select("t", "i", (F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))).cast("bigint").alias("label"))


def exact_sum(col: str) -> Column:
    """Sum of doubles that hold whole hundredths, in whole numbers: equal rows have equal sums in any order. Others are summed as doubles."""
    cents = f"try_cast(round({col} * 100) as bigint)"
    whole = f"{col} is null or coalesce(abs({col}) < 1e9 and {cents} / 100.0d = {col}, false)"
    return F.expr(f"coalesce(case when bool_and({whole}) then try_sum(case when {whole} then {cents} end) / 100.0d end, sum({col}))")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Units with covariates: nation, region, population (quantity), wage (mean price), orders, band of the balance.

    Prices are summed exactly, so that units with the same prices are tied in rank, whatever the order of rows.
    """
    s, n = read_table(spark, d, "supplier"), read_table(spark, d, "nation")
    x = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("population"), (exact_sum("l_extendedprice") / F.count("l_extendedprice")).alias("wage"), F.count_distinct("l_orderkey").alias("orders"))
    band = F.when(F.col("s_acctbal") < 0, "neg").when(F.col("s_acctbal") < 5000, "mid").otherwise("high")
    s = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(x, s.s_suppkey == x.l_suppkey)  # nation: 25 rows by definition
    return s.select(F.col("s_suppkey").alias("unit"), F.col("s_nationkey").cast("bigint").alias("nation"), F.col("n_regionkey").cast("bigint").alias("region"), band.alias("band"), F.col("s_acctbal").alias("balance"), "population", "wage", "orders")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison with an oracle; negative zero becomes zero."""
    return df.select(*(F.round(F.col(f"`{c}`") + F.lit(0.0), digits).alias(c) + F.lit(0.0) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes)).toDF(*df.columns)


# --- SQL of the same bindings ------------------------------------------------------------------

P_CTE = """
raw AS (SELECT l_suppkey AS unit, CAST((year(l_shipdate) - 1996) * 2 + CASE WHEN month(l_shipdate) > 6 THEN 1 ELSE 0 END AS INTEGER) AS t, p_type AS category, l_extendedprice AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2001-01-01'),
cells AS MATERIALIZED (SELECT unit, t, category, sum(value) AS value FROM raw GROUP BY ALL),
whole AS (SELECT unit FROM cells GROUP BY unit HAVING count(*) = 60),
panel AS MATERIALIZED (SELECT * FROM cells WHERE unit IN (SELECT unit FROM whole)),
clr AS MATERIALIZED (SELECT unit, t, category, ln(value) - avg(ln(value)) OVER (PARTITION BY unit, t) AS clr FROM panel),
tot AS (SELECT unit, t, ln(sum(value)) AS ln_total FROM panel GROUP BY ALL),
med AS (SELECT t, median(ln_total) AS m FROM tot GROUP BY t),
mad AS (SELECT tot.t, 1.4826 * median(abs(ln_total - m)) AS s FROM tot JOIN med USING (t) GROUP BY tot.t),
lvl AS (SELECT unit, t, (ln_total - m) / s AS z FROM tot JOIN med USING (t) JOIN mad USING (t))
"""
FEATURE_CTE = P_CTE + """,
ps AS (SELECT a.t, sqrt(sum((a.clr - b.clr) ** 2)) AS d FROM clr a JOIN clr b ON a.t = b.t AND a.category = b.category AND a.unit < b.unit GROUP BY a.t, a.unit, b.unit),
ss AS (SELECT t, median(d) AS s FROM ps GROUP BY t),
sl AS (SELECT a.t, median(abs(a.z - b.z)) AS s FROM lvl a JOIN lvl b ON a.t = b.t AND a.unit < b.unit GROUP BY a.t),
feat AS MATERIALIZED (SELECT clr.t, unit, category AS dim, clr * sqrt(0.7) / s AS x FROM clr JOIN ss USING (t) UNION ALL SELECT lvl.t, unit, 'level', z * sqrt(0.3) / s FROM lvl JOIN sl USING (t)),
dist AS MATERIALIZED (SELECT a.t AS g, a.unit AS i, b.unit AS j, sqrt(sum((a.x - b.x) ** 2)) AS d FROM feat a JOIN feat b ON a.t = b.t AND a.dim = b.dim AND a.unit <> b.unit GROUP BY ALL),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY d, j) AS rank FROM dist) WHERE rank <= 5),
sig AS (SELECT g, i, max(d) AS s FROM near GROUP BY ALL),
edges AS MATERIALIZED (SELECT a.g, a.i AS src, a.j AS dst, exp(-a.d * a.d / (x.s * y.s + 1e-12)) AS weight, a.d AS distance FROM near a JOIN near b ON a.g = b.g AND a.i = b.j AND a.j = b.i AND a.i < a.j
  JOIN sig x ON x.g = a.g AND x.i = a.i JOIN sig y ON y.g = a.g AND y.i = a.j)
"""
E_CTE = """
e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)
"""
RUNS_CTE = E_CTE + """,
runs AS (SELECT run, run % 4 AS family, i, CAST((v[run*3+1] > 0)::INT * 4 + (v[run*3+2] > 0)::INT * 2 + (v[run*3+3] > 0)::INT AS BIGINT) AS label FROM e, (SELECT CAST(unnest(range(12)) AS INTEGER) AS run))
"""
GRAPH_E_CTE = E_CTE + """,
dist AS MATERIALIZED (SELECT a.i, b.i AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.i <> b.i),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM dist) WHERE rank <= 10),
sig AS (SELECT i, max(d) AS s FROM near GROUP BY ALL),
edges AS MATERIALIZED (SELECT a.i AS src, a.j AS dst, exp(-a.d * a.d / (x.s * y.s + 1e-12)) AS weight, a.d AS distance FROM near a JOIN near b ON a.i = b.j AND a.j = b.i AND a.i < a.j
  JOIN sig x ON x.i = a.i JOIN sig y ON y.i = a.j),
both_ways AS (SELECT src AS i, dst AS j, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)
"""
LABELS_CTE = P_CTE + """,
lab AS MATERIALIZED (SELECT t, unit AS i, CAST(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], category) AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY unit, t ORDER BY value DESC, category) AS place FROM panel) WHERE place = 1)
"""
SUPPLIER_CTE = """
sup AS MATERIALIZED (SELECT s_suppkey AS unit, CAST(s_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS region, CASE WHEN s_acctbal < 0 THEN 'neg' WHEN s_acctbal < 5000 THEN 'mid' ELSE 'high' END AS band, s_acctbal AS balance, population, wage, orders
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT l_suppkey, sum(l_quantity) AS population, avg(l_extendedprice) AS wage, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)
"""


