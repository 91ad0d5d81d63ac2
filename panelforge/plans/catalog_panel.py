"""Panel, composition and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import stash
from ..functions import columns as C
from ..operators import graphs as G
from ..operators import panel as P
from ..operators.pairs import knn, pair_shares
from ..session import read_table
from . import bindings as B
from .bindings import E_CTE, FEATURE_CTE, GRAPH_E_CTE, P_CTE
from .registry import query


@query("panel_audit", P_CTE, """SELECT (SELECT count(*) FROM cells) AS raw_rows, (SELECT count(DISTINCT unit) FROM cells) AS units, (SELECT count(DISTINCT t) FROM cells) AS periods,
  CAST(0 AS BIGINT) AS ambiguous, (SELECT count(*) FROM whole) AS complete, (SELECT count(*) FROM whole) AS strict""")
def panel_audit(spark, d):
    return P.strict_panel(B.cells(spark, d), categories=B.CATEGORIES, periods=B.PERIODS).audit


@query("panel_strict_units", P_CTE, "SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS idx FROM whole")
def panel_strict_units(spark, d):
    return P.strict_panel(B.cells(spark, d), categories=B.CATEGORIES, periods=B.PERIODS).units


@query("panel_strict_rows", P_CTE + ", twice AS (SELECT * FROM cells UNION ALL SELECT * FROM cells WHERE unit % 37 = 0 AND t = 3), bad AS (SELECT DISTINCT unit FROM twice GROUP BY unit, category, t HAVING count(*) > 1)", "SELECT * FROM panel WHERE unit NOT IN (SELECT unit FROM bad)", "value")
def panel_strict_rows(spark, d):
    c = B.cells(spark, d)
    twice = c.union(c.where("unit % 37 = 0 and t = 3"))
    return P.strict_panel(twice, categories=B.CATEGORIES, periods=B.PERIODS).panel


@query("panel_ambiguous_units", P_CTE + ", twice AS (SELECT * FROM cells UNION ALL SELECT * FROM cells WHERE unit % 37 = 0 AND t = 3)", "SELECT DISTINCT unit FROM twice GROUP BY unit, category, t HAVING count(*) > 1")
def panel_ambiguous_units(spark, d):
    c = B.cells(spark, d)
    return P.ambiguous_units(c.union(c.where("unit % 37 = 0 and t = 3")), "unit", "category", "t")


@query("panel_calendar_gap", P_CTE, "SELECT unit, category, CAST(x.t AS INTEGER) AS t FROM (SELECT DISTINCT unit, category FROM cells), (SELECT unnest(range(10)) AS t) x WHERE (unit, category, x.t) NOT IN (SELECT (unit, category, t) FROM cells)")
def panel_calendar_gap(spark, d):
    """Missing periods of each (unit, category) against the expected calendar."""
    c = B.cells(spark, d)
    wanted = c.select("unit", "category").distinct().select("unit", "category", F.explode(F.array(*map(F.lit, B.PERIODS))).alias("t"))
    return wanted.join(c, ["unit", "category", "t"], "left_anti")


@query("panel_shares", P_CTE, "SELECT unit, t, category, value / sum(value) OVER (PARTITION BY unit, t) AS share FROM panel", "share")
def panel_shares(spark, d):
    return P.shares(B.panel(spark, d)).select("unit", "t", "category", "share")


@query("panel_residual_other", P_CTE + ", withtotal AS (SELECT * FROM panel UNION ALL SELECT unit, t, 'TOTAL', sum(value) FROM panel GROUP BY unit, t)", """SELECT unit, t, category, value FROM panel WHERE category <> 'PROMO'
  UNION ALL SELECT unit, t, 'Other', sum(CASE WHEN category = 'TOTAL' THEN value ELSE 0 END) - sum(CASE WHEN category NOT IN ('TOTAL', 'PROMO') THEN value ELSE 0 END) FROM withtotal GROUP BY unit, t""", "value")
def panel_residual_other(spark, d):
    p = B.panel(spark, d)
    total = p.groupBy("unit", "t").agg(F.sum("value").alias("value")).select("unit", "t", F.lit("TOTAL").alias("category"), "value")
    return P.with_residual(p.unionByName(total), B.SELECTED, "TOTAL")


@query("panel_wide", P_CTE, "SELECT * FROM (PIVOT panel ON category IN ('ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD') USING sum(value) GROUP BY unit, t)", "ECONOMY LARGE MEDIUM PROMO SMALL STANDARD")
def panel_wide(spark, d):
    return B.panel(spark, d).groupBy("unit", "t").pivot("category", B.CATEGORIES).agg(F.sum("value"))


@query("panel_unpivot", P_CTE, "SELECT unit, t, category, value FROM panel", "value")
def panel_unpivot(spark, d):
    wide = B.panel(spark, d).groupBy("unit", "t").pivot("category", B.CATEGORIES).agg(F.sum("value"))
    return wide.unpivot(["unit", "t"], B.CATEGORIES, "category", "value")


@query("panel_snapshot_interval", "", """SELECT c_custkey AS id, c_custkey % 8 + 2016 + k * 3 AS year_from, CASE WHEN k = 0 THEN c_custkey % 8 + 2019 ELSE 9999 END AS year_to, k AS version
  FROM customer, (SELECT CAST(unnest(range(2)) AS INTEGER) AS k) WHERE c_custkey % 8 + 2016 + k * 3 <= 2021 AND CASE WHEN k = 0 THEN c_custkey % 8 + 2019 ELSE 9999 END > 2021""")
def panel_snapshot_interval(spark, d):
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("version")
    base = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), k)
    versions = base.selectExpr("id", "id % 8 + 2016 + version * 3 as year_from", "case when version = 0 then id % 8 + 2019 else 9999 end as year_to", "version")
    return P.snapshot(versions, 2021, "id")


@query("panel_eligibility_reason", "", """SELECT c_custkey AS id, CASE WHEN c_mktsegment IS NULL THEN 'no_segment' WHEN NOT c_acctbal >= 0 THEN 'negative_balance' WHEN NOT c_nationkey BETWEEN 5 AND 20 THEN 'nation_out_of_range' ELSE 'eligible' END AS reason FROM customer""")
def panel_eligibility_reason(spark, d):
    checks = [("no_segment", "c_mktsegment is not null"), ("negative_balance", "c_acctbal >= 0"), ("nation_out_of_range", "c_nationkey between 5 and 20")]
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), P.first_reason(checks))


@query("filtered_scan_counts", "", "SELECT count(*) AS rows_read, count(*) FILTER (year(l_shipdate) = 1998) AS year_rows, count(*) FILTER (year(l_shipdate) = 1998 AND p_type LIKE 'S%') AS type_rows, count(*) FILTER (year(l_shipdate) = 1998 AND p_type LIKE 'S%' AND l_returnflag = 'R') AS kept FROM lineitem JOIN part ON l_partkey = p_partkey")
def filtered_scan_counts(spark, d):
    """Chained scan filters with a counter for each stage, in one pass."""
    x = read_table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag").join(read_table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    year = F.year("l_shipdate") == 1998
    kind = year & F.col("p_type").startswith("S")
    return x.agg(F.count("*").alias("rows_read"), F.count_if(year).alias("year_rows"), F.count_if(kind).alias("type_rows"), F.count_if(kind & (F.col("l_returnflag") == "R")).alias("kept"))


# composition -----------------------------------------------------------------------------------

@query("clr_parts", P_CTE, "SELECT * FROM clr", "clr")
def clr_parts(spark, d):
    return P.clr_parts(B.panel(spark, d))


@query("robust_level", P_CTE, "SELECT unit, t, z FROM lvl", "z")
def robust_level(spark, d):
    return P.robust_level(B.panel(spark, d))


@query("block_scale_structure", FEATURE_CTE, "SELECT t, s AS distance FROM ss", "distance")
def block_scale_structure(spark, d):
    return P.median_pair_distance(P.vectors(P.clr_parts(B.panel(spark, d)), "clr"), "t", "unit", "vec")


@query("block_scale_level", FEATURE_CTE, "SELECT t, s AS distance FROM sl", "distance")
def block_scale_level(spark, d):
    return P.median_pair_distance(P.robust_level(B.panel(spark, d)).select("unit", "t", F.array("z").alias("vec")), "t", "unit", "vec")


@query("features_weighted", FEATURE_CTE, "SELECT t, unit, CAST(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD','level'], dim) - 1 AS INTEGER) AS dim, x FROM feat", "x")
def features_weighted(spark, d):
    return P.features(B.panel(spark, d)).select("t", "unit", F.posexplode("vec").alias("dim", "x"))


@query("zscore_pop", P_CTE, "SELECT unit, t, category, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM panel WINDOW w AS (PARTITION BY t, category)", "z")
def zscore_pop(spark, d):
    return B.panel(spark, d).select("unit", "t", "category", C.zscore("value", "t", "category").alias("z"))


@query("zero_replacement_clr", """q AS (SELECT l_suppkey AS unit, p_brand AS category, CASE WHEN sum(l_quantity) < 100 THEN 0.0 ELSE sum(l_quantity) END AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  f AS (SELECT unit, category, CASE WHEN value > 0 THEN value ELSE 0.5 * min(CASE WHEN value > 0 THEN value END) OVER (PARTITION BY unit) END AS v FROM q)""", "SELECT unit, category, ln(v) - avg(ln(v)) OVER (PARTITION BY unit) AS clr FROM f WHERE v IS NOT NULL", "clr")
def zero_replacement_clr(spark, d):
    x = read_table(spark, d, "lineitem").join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("unit"), F.col("p_brand").alias("category")).agg(F.sum("l_quantity").alias("value"))
    x = x.withColumn("value", F.when(F.col("value") < 100, 0.0).otherwise(F.col("value"))).withColumn("v", C.zero_replaced("value", "unit")).where("v is not null")
    return x.select("unit", "category", C.clr("v", "unit").alias("clr"))


@query("aitchison_pairs", P_CTE, "SELECT a.unit, a.t, sqrt(sum((a.clr - b.clr) ** 2)) AS distance FROM clr a JOIN clr b ON a.unit = b.unit AND a.category = b.category AND b.t = a.t + 1 GROUP BY ALL", "distance")
def aitchison_pairs(spark, d):
    """Aitchison distance of each unit's composition to its next period's."""
    c = P.clr_parts(B.panel(spark, d))
    return P.aitchison(c, c.withColumn("t", F.col("t") - 1), ["unit", "t"])


@query("composition_volatility", P_CTE + ", ch AS (SELECT unit, category, clr - lag(clr) OVER (PARTITION BY unit, category ORDER BY t) AS x FROM clr), ce AS (SELECT unit, x - avg(x) OVER (PARTITION BY unit, category) AS e FROM ch WHERE x IS NOT NULL)", "SELECT unit, sqrt(avg(e * e)) AS volatility FROM ce GROUP BY unit", "volatility")
def composition_volatility(spark, d):
    return P.composition_volatility(B.panel(spark, d))


@query("total_volatility", P_CTE, "SELECT unit, stddev_samp(x) AS volatility FROM (SELECT unit, ln_total - lag(ln_total) OVER (PARTITION BY unit ORDER BY t) AS x FROM tot) GROUP BY unit", "volatility")
def total_volatility(spark, d):
    return P.total_volatility(B.panel(spark, d))


@query("alt_five_part_clr", P_CTE, "SELECT unit, t, category, ln(value) - avg(ln(value)) OVER (PARTITION BY unit, t) AS clr FROM panel WHERE category <> 'PROMO'", "clr")
def alt_five_part_clr(spark, d):
    return P.clr_parts(B.panel(spark, d).where(F.col("category").isin(B.SELECTED)))


@query("alt_log_levels", P_CTE + ", m1 AS (SELECT t, category, median(ln(value)) AS m FROM panel GROUP BY ALL), m2 AS (SELECT t, category, 1.4826 * median(abs(ln(value) - m)) AS s FROM panel JOIN m1 USING (t, category) GROUP BY ALL)", "SELECT unit, t, category, (ln(value) - m) / s AS z FROM panel JOIN m1 USING (t, category) JOIN m2 USING (t, category)", "z")
def alt_log_levels(spark, d):
    return P.log_levels(B.panel(spark, d))


@query("min_max_scaled", P_CTE, "SELECT unit, t, category, CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS up FROM panel WINDOW w AS (PARTITION BY t, category)", "up")
def min_max_scaled(spark, d):
    return B.panel(spark, d).select("unit", "t", "category", C.min_max("value", "t", "category").alias("up"))


@query("cosine_to_centre", E_CTE + ", x AS (SELECT i, label, unnest(v) AS x, unnest(range(64)) AS dim FROM e), m AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY ALL)", "SELECT i, label, 1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS distance FROM x JOIN m USING (label, dim) GROUP BY i, label", "distance")
def cosine_to_centre(spark, d):
    e = B.points_e(spark, d)
    centres = e.select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("m"))
    centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda r: r["m"]).alias("centre"))
    return e.join(centres, "label").select("i", "label", C.cosine_distance(F.col("vec"), F.col("centre")).alias("distance"))


@query("distance_contribution", FEATURE_CTE + """, blk AS (SELECT a.t, a.unit AS i, b.unit AS j, CASE WHEN a.dim = 'level' THEN 'level' ELSE 'structure' END AS block, sum((a.x - b.x) ** 2) AS s FROM feat a JOIN feat b ON a.t = b.t AND a.dim = b.dim AND a.unit < b.unit GROUP BY ALL),
  sh AS (SELECT t, block, s / sum(s) OVER (PARTITION BY t, i, j) AS share FROM blk)""", "SELECT t, block, avg(share) AS mean_share, median(share) AS median_share FROM sh JOIN (SELECT 1) ON true GROUP BY ALL", "mean_share median_share")
def distance_contribution(spark, d):
    """Share of the squared distance that each feature block brings, over the pairs of a period."""
    return pair_shares(P.features(B.panel(spark, d)), 6, ("structure", "level"), group="t", key="unit", vec="vec")


# graphs --------------------------------------------------------------------------------------------

@query("knn_directed", FEATURE_CTE, "SELECT g, i, j, d, CAST(rank AS INTEGER) AS rank FROM near", "d")
def knn_directed(spark, d):
    return B.near_p(spark, d)


@query("knn_mutual", FEATURE_CTE, "SELECT g, src, dst, weight, distance FROM edges", "weight distance")
def knn_mutual(spark, d):
    return G.knn_graph(B.near_p(spark, d)).drop("fallback")


@query("knn_union", FEATURE_CTE, "SELECT n.g, least(n.i, n.j) AS src, greatest(n.i, n.j) AS dst, max(exp(-n.d * n.d / (x.s * y.s + 1e-12))) AS weight, max(n.d) AS distance FROM near n JOIN sig x ON x.g = n.g AND x.i = n.i JOIN sig y ON y.g = n.g AND y.i = n.j GROUP BY 1, 2, 3", "weight distance")
def knn_union(spark, d):
    return G.knn_graph(B.near_p(spark, d), mutual=False).drop("fallback").distinct()


@query("isolate_fallback", FEATURE_CTE + ", lone AS (SELECT * FROM near WHERE rank = 1 AND (g, i) NOT IN (SELECT (g, src) FROM edges) AND (g, i) NOT IN (SELECT (g, dst) FROM edges))", """SELECT g, src, dst, distance, false AS fallback FROM edges UNION ALL SELECT DISTINCT g, least(i, j), greatest(i, j), d, true FROM lone""", "distance")
def isolate_fallback(spark, d):
    return G.knn_graph(B.near_p(spark, d), fallback=True).drop("weight")


_EPS = FEATURE_CTE + ", eps AS (SELECT g, d AS eps FROM (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) AS r FROM dist WHERE i < j) WHERE r = 20), el AS (SELECT dist.g, i AS src, j AS dst, d FROM dist JOIN eps USING (g) WHERE i < j AND d <= eps)"


def _epsilon(spark, d):
    pts = B.points_p(spark, d)
    return G.epsilon_graph(pts, knn(pts, B.K, group="g", key="i", vec="vec"), 20, key="i", vec="vec")


@query("epsilon_edges", _EPS, "SELECT el.g, src, dst, exp(-d * d / (x.s * y.s + 1e-12)) AS weight, d AS distance FROM el JOIN sig x ON x.g = el.g AND x.i = src JOIN sig y ON y.g = el.g AND y.i = dst", "weight distance")
def epsilon_edges(spark, d):
    return _epsilon(spark, d)[0].drop("fallback")


@query("epsilon_calibration", _EPS, "SELECT g, CAST(20 AS BIGINT) AS target, eps, count(*) AS edges, count(*) - 20 AS excess, (SELECT count(DISTINCT unit) FROM panel) - (SELECT count(DISTINCT u) FROM (SELECT src AS u FROM el z WHERE z.g = el.g UNION ALL SELECT dst FROM el z WHERE z.g = el.g)) AS isolates FROM el JOIN eps USING (g) GROUP BY g, eps", "eps")
def epsilon_calibration(spark, d):
    return _epsilon(spark, d)[1]


_DYN = P_CTE + """, ch AS (SELECT unit, category, t, clr - lag(clr) OVER (PARTITION BY unit, category ORDER BY t) AS x FROM clr), ce AS (SELECT unit, category, t, x - avg(x) OVER (PARTITION BY unit, category) AS e FROM ch WHERE x IS NOT NULL),
  cn AS MATERIALIZED (SELECT unit, category, t, e / sqrt(sum(e * e) OVER (PARTITION BY unit, category)) AS n FROM ce),
  sim AS MATERIALIZED (SELECT a.unit AS i, b.unit AS j, sum(a.n * b.n) / 6 AS s FROM cn a JOIN cn b ON a.category = b.category AND a.t = b.t AND a.unit <> b.unit GROUP BY ALL),
  nr AS MATERIALIZED (SELECT * FROM (SELECT i, j, s, sqrt(2 * greatest(0, 1 - s)) AS d, row_number() OVER (PARTITION BY i ORDER BY sqrt(2 * greatest(0, 1 - s)), j) AS rank FROM sim) WHERE rank <= 5), sg AS (SELECT i, max(d) AS s FROM nr GROUP BY i)"""


@query("codynamics_similarity", _DYN, "SELECT i, j, s AS similarity, CAST(rank AS INTEGER) AS rank FROM nr", "similarity")
def codynamics_similarity(spark, d):
    """The most similar units by their changes: mean per-part correlation of the five nearest."""
    v = G.dynamics_vectors(P.clr_parts(B.panel(spark, d))).withColumn("g", F.lit(0))
    return knn(v, 5, group="g", key="unit", vec="vec").select("i", "j", (1 - F.col("d") * F.col("d") / 2).alias("similarity"), "rank")


@query("codynamics_mutual", _DYN, "SELECT a.i AS src, a.j AS dst, exp(-a.d * a.d / (x.s * y.s + 1e-12)) AS weight, a.s AS similarity FROM nr a JOIN nr b ON a.i = b.j AND a.j = b.i AND a.i < a.j JOIN sg x ON x.i = a.i JOIN sg y ON y.i = a.j", "weight similarity")
def codynamics_mutual(spark, d):
    return G.dynamics_graph(G.dynamics_vectors(P.clr_parts(B.panel(spark, d))), 5).select("src", "dst", "weight", "similarity")


_SUPRA = FEATURE_CTE + ", supra AS (SELECT g AS t, src, g AS t2, dst, weight, 'intra' AS kind FROM edges UNION ALL SELECT CAST(x.t AS INTEGER), unit, CAST(x.t + 1 AS INTEGER), unit, 2.0 * (SELECT median(weight) FROM edges), 'temporal' FROM whole, (SELECT unnest(range(9)) AS t) x)"


def supra(spark, d, omega: float = 2.0):
    pts = B.points_p(spark, d)
    return G.supra_graph(G.knn_graph(knn(pts, B.K, group="g", key="i", vec="vec")), pts.select("g", "i"), omega)


@query("supra_edges", _SUPRA, "SELECT * FROM supra", "weight")
def supra_edges(spark, d):
    return supra(spark, d)


_H = "xor((xor(({0} * 48271) % 2147483647, 1540483477) * 16807 + 11) % 2147483647, 668265261)"


def _hash_sql(*parts: str) -> str:
    h = "CAST(12345 AS BIGINT)"
    for p in parts:
        h = _H.format(f"({h} + CAST({p} AS BIGINT) % 2147483647 + 1)")
    return f"((({h} * 69621) % 2147483647) + 0.5) / 2147483647"


_U0, _U1, _U2 = _hash_sql("7", "t", "src", "dst"), _hash_sql("7", "t", "src", "dst", "7", "1"), _hash_sql("7", "t", "src", "dst", "7", "2")


@query("edge_perturb_hash", _SUPRA, f"SELECT t, src, t2, dst, kind, CASE WHEN kind = 'temporal' THEN weight ELSE weight * exp(0.02 * sqrt(-2 * ln({_U1})) * cos(2 * pi() * {_U2})) END AS weight FROM supra WHERE kind = 'temporal' OR {_U0} >= 0.05", "weight")
def edge_perturb_hash(spark, d):
    return G.perturb(supra(spark, d), 7)


def _graph_p(spark, d):
    pts = B.points_p(spark, d)
    return G.knn_graph(knn(pts, B.K, group="g", key="i", vec="vec")), pts


_BOTH = FEATURE_CTE + ", both_ways AS (SELECT g, src AS i, dst AS j, weight FROM edges UNION ALL SELECT g, dst, src, weight FROM edges), deg AS (SELECT g, i, count(*) AS degree, sum(weight) AS strength FROM both_ways GROUP BY ALL)"


@query("graph_degree", _BOTH, "SELECT * FROM deg", "strength")
def graph_degree(spark, d):
    return G.degrees(_graph_p(spark, d)[0])


_COMP = "RECURSIVE" + _BOTH + ", nodes AS (SELECT DISTINCT t AS g, unit AS i FROM feat), reach(g, i, r) AS (SELECT g, i, i FROM nodes UNION SELECT reach.g, reach.i, b.j FROM reach JOIN both_ways b ON reach.g = b.g AND reach.r = b.i), comp AS (SELECT g, i, min(r) AS component FROM reach GROUP BY ALL)"


@query("connected_components", _COMP, "SELECT * FROM comp")
def connected_components(spark, d):
    edges, pts = _graph_p(spark, d)
    return G.node_table(edges, pts.select("g", "i")).select("g", "i", "component")


@query("graph_node_table", _COMP, "SELECT g, i, coalesce(degree, 0) AS degree, coalesce(strength, 0.0) AS strength, component FROM comp LEFT JOIN deg USING (g, i)", "strength")
def graph_node_table(spark, d):
    edges, pts = _graph_p(spark, d)
    return G.node_table(edges, pts.select("g", "i"))


@query("graph_diagnostics", _COMP + ", tab AS (SELECT g, i, coalesce(degree, 0) AS degree, component FROM comp LEFT JOIN deg USING (g, i)), es AS (SELECT g, count(*) AS edges, sum(weight) AS total_weight FROM edges GROUP BY g)", """SELECT g, count(*) AS nodes, any_value(edges) AS edges, 2 * any_value(edges) / (count(*) * (count(*) - 1)) AS density, avg(degree) AS mean_degree, max(degree) AS max_degree, count(DISTINCT component) AS components, count(*) FILTER (degree = 0) AS isolates, any_value(total_weight) AS total_weight, CAST(0 AS BIGINT) AS negative FROM tab JOIN es USING (g) GROUP BY g""", "density mean_degree total_weight")
def graph_diagnostics(spark, d):
    edges, pts = _graph_p(spark, d)
    edges = stash(edges)  # read by degrees, components and totals
    return G.graph_diagnostics(edges, G.node_table(edges, pts.select("g", "i")))


@query("topology_distribution", _BOTH, "SELECT 'degree' AS what, count(*) AS n, avg(degree) AS mean, median(degree) AS median, coalesce(stddev_samp(degree), 0) AS sd, quantile_cont(degree, 0.1) AS q10, quantile_cont(degree, 0.9) AS q90 FROM deg UNION ALL SELECT 'weight', count(*), avg(weight), median(weight), coalesce(stddev_samp(weight), 0), quantile_cont(weight, 0.1), quantile_cont(weight, 0.9) FROM edges", "mean median sd q10 q90")
def topology_distribution(spark, d):
    edges, _ = _graph_p(spark, d)
    rows = G.degrees(edges).select(F.lit("degree").alias("what"), F.col("degree").cast("double").alias("x")).union(edges.select(F.lit("weight"), "weight"))
    return rows.groupBy("what").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.percentile("x", 0.1).alias("q10"), F.percentile("x", 0.9).alias("q90"))


@query("edge_jaccard", FEATURE_CTE, "SELECT a.g, count(*) FILTER (b.src IS NOT NULL) AS common, count(*) AS either, count(*) FILTER (b.src IS NOT NULL) / count(*) AS jaccard FROM (SELECT DISTINCT g, least(i, j) AS src, greatest(i, j) AS dst FROM near) a LEFT JOIN edges b USING (g, src, dst) GROUP BY a.g", "jaccard")
def edge_jaccard(spark, d):
    near = stash(B.near_p(spark, d))
    return G.edge_jaccard(G.knn_graph(near), G.knn_graph(near, mutual=False))


@query("modularity_residual", _BOTH, "SELECT e.g, src, dst, weight - a.strength * b.strength / (SELECT sum(strength) FROM deg z WHERE z.g = e.g) AS residual FROM edges e JOIN deg a ON a.g = e.g AND a.i = src JOIN deg b ON b.g = e.g AND b.i = dst", "residual")
def modularity_residual(spark, d):
    return G.modularity_residual(_graph_p(spark, d)[0])


@query("induced_subgraph", FEATURE_CTE, "SELECT g, src, dst, weight, distance FROM edges WHERE src % 3 <> 0 AND dst % 3 <> 0", "weight distance")
def induced_subgraph(spark, d):
    edges, pts = _graph_p(spark, d)
    return G.induced(edges, pts.where("i % 3 <> 0").select("g", "i")).drop("fallback")


@query("canonical_edges", FEATURE_CTE, "SELECT g, src, dst, weight FROM edges", "weight")
def canonical_edges(spark, d):
    edges, _ = _graph_p(spark, d)
    return G.canonical_edges(edges.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


@query("block_matrix", GRAPH_E_CTE, "SELECT a.label AS ci, b.label AS cj, sum(weight) AS s FROM both_ways w JOIN e a ON a.i = w.i JOIN e b ON b.i = w.j GROUP BY ALL", "s")
def block_matrix(spark, d):
    edges = G.knn_graph(B.near_e(spark, d))
    return G.block_matrix(edges, B.points_e(spark, d).select("g", "i", "label")).drop("g")


@query("knn_embeddings", GRAPH_E_CTE, "SELECT i, j, d, CAST(rank AS INTEGER) AS rank FROM near", "d", 5)
def knn_embeddings(spark, d):
    return B.near_e(spark, d).drop("g")
