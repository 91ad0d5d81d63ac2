"""Context, spatial, display and battery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import stash
from ..operators import consensus as S
from ..operators import context as X
from ..operators import graphs as G
from ..operators import ml as M
from ..operators import panel as P
from ..operators import synthetic as Y
from ..session import read_table as T
from . import bindings as B
from .bindings import E_CTE, FEATURE_CTE, P_CTE, SUPPLIER_CTE
from .catalog_inference import _FEATURES, _POIS, _REP, _BU, _doc_rows
from .catalog_partitions import _AFF, _fam
from .catalog_relational import _LL, _lonlat
from .registry import query


@query("context_match", E_CTE + ", r AS (SELECT a.i, b.i AS j, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.v, b.v), b.i) AS p FROM e a JOIN e b ON a.label <> b.label)", "SELECT i, j, d FROM r WHERE p = 1", "d")
def context_match(spark, d):
    """The nearest unit of another profile."""
    return X.nearest_other(B.points_e(spark, d), "label").drop("g")


@query("match_quality", SUPPLIER_CTE, "SELECT a.unit AS i, b.unit AS j, greatest(abs(a.wage - b.wage) / abs(a.wage), abs(a.population - b.population) / abs(a.population)) AS difference, CASE WHEN greatest(abs(a.wage - b.wage) / abs(a.wage), abs(a.population - b.population) / abs(a.population)) <= 0.1 THEN 'close' WHEN greatest(abs(a.wage - b.wage) / abs(a.wage), abs(a.population - b.population) / abs(a.population)) <= 0.25 THEN 'fair' ELSE 'loose' END AS quality FROM sup a JOIN sup b ON b.unit = a.unit + 1", "difference")
def match_quality(spark, d):
    s = B.suppliers(spark, d)
    return X.match_quality(s.select(F.col("unit").alias("i"), (F.col("unit") + 1).alias("j")), s, "unit", ["wage", "population"])


_GEO = FEATURE_CTE + ", " + _LL + """, bw AS (SELECT g, src AS i, dst AS j, distance AS d FROM edges UNION ALL SELECT g, dst, src, distance FROM edges), t3 AS (SELECT g, i, j FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY d, j) AS p FROM bw) WHERE p <= 3),
 hv AS (SELECT g, i, j, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM t3 JOIN ll a ON a.k = i JOIN ll b ON b.k = j), km AS (SELECT g, i, j, 6371.0088 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM hv)"""


def _places(spark, d):
    return _lonlat(spark, d).withColumnRenamed("k", "unit")


@query("neighbor_geography", _GEO, "SELECT g, count(*) AS pairs, median(km) AS median_km, avg((km > 500)::INT) AS far_share FROM km GROUP BY g", "median_km far_share", 4)
def neighbor_geography(spark, d):
    return X.neighbour_geography(G.knn_graph(B.near_p(spark, d)), _places(spark, d))[1]


@query("spatial_block_null", P_CTE + ", " + _LL + """, c AS (SELECT sqrt(0.00669437999014) AS e, cos(radians(30)) / sqrt(1 - 0.00669437999014 * sin(radians(30)) ** 2) AS k0), bl AS (SELECT k, CAST(floor(radians(lon) * 6378137.0 * k0 / 1500000) AS BIGINT) || ':' || CAST(floor((1 - e * e) * (sin(radians(lat)) / (1 - e * e * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) * 6378137.0 / (2 * k0) / 1500000) AS BIGINT) AS b FROM ll, c),
 z AS (SELECT unit, b, z, unit % 2 = 0 AS f FROM lvl JOIN bl ON k = unit WHERE t = 9), st AS (SELECT b, count(*) AS n, count(*) FILTER (f) AS m FROM z GROUP BY b), pr AS (SELECT x.b AS gi, y.b AS gj, sum(abs(x.z - y.z)) AS s FROM z x JOIN z y ON x.unit <> y.unit GROUP BY ALL),
 ex AS (SELECT sum(CASE WHEN gi <> gj THEN (a.m / a.n) * (b.m / b.n) * s WHEN a.n > 1 THEN a.m * (a.m - 1) / (a.n * (a.n - 1)) * s ELSE 0 END) / 2 / ((SELECT sum(m) FROM st) * ((SELECT sum(m) FROM st) - 1) / 2) AS expected FROM pr JOIN st a ON a.b = gi JOIN st b ON b.b = gj), ob AS (SELECT avg(abs(x.z - y.z)) AS observed FROM z x JOIN z y ON x.unit <> y.unit AND x.f AND y.f)""",
       "SELECT 1500.0::DOUBLE AS size_km, 0.0::DOUBLE AS shift, observed, expected, observed / expected AS ratio FROM ex, ob", "observed expected ratio")
def spatial_block_null(spark, d):
    """Distance among flagged units against its exact expectation within spatial blocks."""
    x = P.robust_level(B.panel(spark, d)).where("t = 9").select(F.col("unit").alias("i"), F.array("z").alias("vec"), (F.col("unit") % 2 == 0).alias("flag"))
    return X.spatial_ratio(x, _places(spark, d), "flag", 1500.0)


@query("display_projection", _AFF + ", an AS (SELECT i, sum(share * cos(2 * pi() * cls / 10)) AS x0, sum(share * sin(2 * pi() * cls / 10)) AS y0, arg_min(cls, (-round(share, 9), cls)) AS best FROM sh GROUP BY i), kk AS (SELECT *, row_number() OVER (PARTITION BY best ORDER BY i) - 1 AS k FROM an)", "SELECT i, best, x0 + 0.01 * sqrt(k) * cos(k * pi() * (3 - sqrt(5))) AS x, y0 + 0.01 * sqrt(k) * sin(k * pi() * (3 - sqrt(5))) AS y FROM kk", "x y")
def display_projection(spark, d):
    return X.display_projection(S.affinities(_fam(spark, d)), list(range(10)))


@query("kernel_grid", SUPPLIER_CTE + ", pt AS (SELECT balance / 1000 AS x, ln(population) AS y, wage AS v FROM sup), gr AS (SELECT CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy FROM (SELECT unnest(range(-40, 60)) AS cx), (SELECT unnest(range(-10, 80)) AS cy)), nn AS (SELECT cx, cy, v, (x - cx * 0.5) ** 2 + (y - cy * 0.5) ** 2 AS d2 FROM gr, pt)", "SELECT cx, cy, count(*) AS support, sum(exp(-d2 / 2) * v) / sum(exp(-d2 / 2)) AS value FROM nn WHERE d2 <= 2.25 GROUP BY cx, cy HAVING count(*) >= 3", "value")
def kernel_grid(spark, d):
    pts = B.suppliers(spark, d).select((F.col("balance") / 1000).alias("x"), F.log("population").alias("y"), F.col("wage").alias("v"))
    return X.kernel_grid(pts, 0.5, 1.0, 1.5, 3)


_LONG = SUPPLIER_CTE + ", lg AS (SELECT unit, band, 'wage' AS indicator, wage AS value FROM sup UNION ALL SELECT unit, band, 'population', population FROM sup UNION ALL SELECT unit, band, 'orders', orders FROM sup)"


@query("merge_omnibus", _LONG + ", r AS (SELECT *, rank() OVER (PARTITION BY indicator ORDER BY value) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY indicator) AS n FROM lg), g AS (SELECT indicator, band, count(*) AS m, sum(r) AS s, any_value(n) AS n FROM r GROUP BY ALL), ti AS (SELECT indicator, sum(t * t * t - t) AS ties FROM (SELECT indicator, value, count(*) AS t FROM lg GROUP BY ALL) GROUP BY indicator), h AS (SELECT indicator, any_value(n) AS n, count(*) AS k, 12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / m) - 3 * (any_value(n) + 1) AS h FROM g GROUP BY indicator)", "SELECT indicator, CAST(n AS BIGINT) AS n, k, h / (1 - ties / (n * n * n - n)) AS h FROM h JOIN ti USING (indicator)", "h")
def merge_omnibus(spark, d):
    return X.merge_tests(B.suppliers(spark, d), "unit", "band", ["wage", "population", "orders"])[0].drop("epsilon2")


@query("merge_pairwise", _LONG, "SELECT a.indicator, a.band AS a, b.band AS b, CAST(sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS DOUBLE) AS u, CAST(avg(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value < b.value THEN -1.0 ELSE 0 END) AS DOUBLE) AS delta FROM lg a JOIN lg b ON a.indicator = b.indicator AND a.band < b.band GROUP BY ALL", "u delta")
def merge_pairwise(spark, d):
    return X.merge_tests(B.suppliers(spark, d), "unit", "band", ["wage", "population", "orders"])[1].drop("na", "nb")


@query("dispersion_bootstrap", _REP + f", w AS (SELECT rep, region, wage, {_POIS} AS w FROM (SELECT rep, region, wage, {_BU} AS u FROM sup, rep)), mm AS (SELECT region, rep, sum(w * wage) / nullif(sum(w), 0) AS mean FROM w GROUP BY region, rep)", "SELECT CAST(rep AS INTEGER) AS rep, stddev_samp(mean) AS dispersion FROM mm GROUP BY rep", "dispersion")
def dispersion_bootstrap(spark, d):
    return X.dispersion_bootstrap(B.suppliers(spark, d), "unit", "region", "wage", 99, 5)


@query("test_battery", SUPPLIER_CTE + ", r AS (SELECT rank() OVER (ORDER BY wage) + (count(*) OVER (PARTITION BY wage) - 1) / 2 AS x, rank() OVER (ORDER BY population) + (count(*) OVER (PARTITION BY population) - 1) / 2 AS y FROM sup)", "SELECT 'rank' AS test, corr(x, y) AS statistic FROM r UNION ALL SELECT 'slope', regr_slope(wage, population) FROM sup UNION ALL SELECT 'middle', median(wage) FROM sup", "statistic", 4)
def test_battery(spark, d):
    tests = [{"name": "rank", "kind": "spearman", "x": "wage", "y": "population"}, {"name": "slope", "kind": "slope", "x": "population", "y": "wage"}, {"name": "middle", "kind": "median", "y": "wage"}]
    return X.battery(B.suppliers(spark, d), tests, "unit")


@query("hypothesis_status", SUPPLIER_CTE, "SELECT CASE WHEN corr(wage, population) > 0.1 AND regr_slope(wage, population) > 0 THEN 'supported' WHEN corr(wage, population) < -0.1 THEN 'contradicted' ELSE 'inconclusive' END AS status FROM sup")
def hypothesis_status(spark, d):
    """Fixed support rules over aggregates."""
    a = B.suppliers(spark, d).agg(F.corr("wage", "population").alias("r"), F.regr_slope(F.col("wage"), F.col("population")).alias("b"))
    return a.select(F.when((F.col("r") > 0.1) & (F.col("b") > 0), "supported").when(F.col("r") < -0.1, "contradicted").otherwise("inconclusive").alias("status"))


@query("public_text_check", "", "SELECT * FROM (SELECT p_partkey, 'missing part' AS problem FROM part WHERE NOT contains(lower(p_name), 'part') UNION ALL SELECT p_partkey, 'banned promo' FROM part WHERE contains(lower(p_name || ' ' || p_type), 'promo'))")
def public_text_check(spark, d):
    x = T(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return X.public_text_problems(x, "p_partkey", "text", ["part"], ["promo"])


@query("period_alignment", "", "SELECT CAST(t AS INTEGER) AS t, 1.0::DOUBLE AS accuracy FROM (SELECT unnest(range(12)) AS t)")
def period_alignment(spark, d):
    """Labels renamed by period and aligned back to the truth."""
    x = Y.truth(spark, "abrupt", 60, 12).select("t", "i", F.col("label").alias("truth")).withColumn("label", (F.col("truth") + F.col("t")) % 3 + 10)
    a = X.align_by_period(x).join(x.select("t", "i", "truth"), ["t", "i"])
    return a.groupBy("t").agg(F.avg((F.col("aligned") == F.col("truth")).cast("double")).alias("accuracy"))


@query("permuted_label_baseline")
def permuted_label_baseline(spark, d):
    """Majority predictions against labels dealt out anew by hash."""
    x = _doc_rows(spark, d).select("doc_id", "source", "quality")
    key = F.struct(F.xxhash64("doc_id", F.lit(5)).alias("h"), F.col("doc_id").alias("d"))
    a = P.numbered(x.select(key.alias("key")), "key").select(F.col("key.d").alias("doc_id"), "idx").join(x.select("doc_id", "quality"), "doc_id").select("idx", "quality")
    b = P.numbered(x.select("doc_id"), "doc_id").join(x.select("doc_id", "source"), "doc_id")
    dealt = a.join(b, "idx").select("doc_id", "source", "quality")
    return M.scores(M.majority_baseline(dealt.join(M.group_folds(dealt, "source", 4), "source"), "quality", "doc_id"))


@query("leave_one_group_out")
def leave_one_group_out(spark, d):
    """Each language held out in turn."""
    x = _doc_rows(spark, d).join(T(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    folds = x.select("lang").distinct().selectExpr("lang", "cast(row_number() over (order by lang) - 1 as int) as fold")
    return M.scores(M.cross_validate(x.join(stash(folds), "lang"), _FEATURES, "quality", "doc_id"))
