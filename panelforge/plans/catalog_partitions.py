"""Partition comparison, validity and consensus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import consensus as S
from ..operators import graphs as G
from ..operators import partitions as Q
from ..operators import validity as V
from . import bindings as B
from .bindings import E_CTE, GRAPH_E_CTE, LABELS_CTE, RUNS_CTE
from .registry import query

# one contingency for each run: g = run, ref = label of the table, cand = label of the run
_CONT = RUNS_CTE + """, cont AS MATERIALIZED (SELECT run AS g, e.label AS ref, runs.label AS cand, count(*) AS n FROM runs JOIN e USING (i) GROUP BY ALL),
 m AS (SELECT *, sum(n) OVER (PARTITION BY g, ref) AS nr, sum(n) OVER (PARTITION BY g, cand) AS nc, sum(n) OVER (PARTITION BY g) AS total FROM cont),
 rk AS (SELECT *, row_number() OVER (PARTITION BY g, ref ORDER BY n DESC, cand) AS place FROM m),
 cw AS (SELECT g, ref, max(nr) AS size, max(CASE WHEN place = 1 THEN cand END) AS dominant, max(CASE WHEN place = 2 THEN cand END) AS second, max(CASE WHEN place = 1 THEN n / nr END) AS retention, greatest(0.0, sum(-(n / nr) * log2(n / nr))) AS entropy_bits, count(*) AS destinations FROM rk GROUP BY g, ref)"""
_PAIRS = _CONT + """, pc AS (SELECT g, sum(n * (n - 1) / 2) AS pb, sum(-(n / total) * ln(n / total)) AS hb, any_value(total) AS total FROM m GROUP BY g),
 pr AS (SELECT g, sum(nr * (nr - 1) / 2) AS p, sum(-(nr / total) * ln(nr / total)) AS h FROM (SELECT DISTINCT g, ref, nr, total FROM m) GROUP BY g), pd AS (SELECT g, sum(nc * (nc - 1) / 2) AS p, sum(-(nc / total) * ln(nc / total)) AS h FROM (SELECT DISTINCT g, cand, nc, total FROM m) GROUP BY g),
 sm AS (SELECT pc.g, pb, hb, total, pr.p AS p1, pr.h AS h1, pd.p AS p2, pd.h AS h2, total * (total - 1) / 2 AS pa FROM pc JOIN pr USING (g) JOIN pd USING (g))"""


def _cont(spark, d):
    ref = B.points_e(spark, d).select("i", F.col("label").alias("ref"))
    return Q.contingency(B.runs_e(spark, d).join(ref, "i").select(F.col("run").alias("g"), "ref", F.col("label").alias("cand")))


@query("contingency", _CONT, "SELECT * FROM cont")
def contingency(spark, d):
    return _cont(spark, d)


@query("ari_nmi", _PAIRS, "SELECT g, (pb - p1 * p2 / pa) / ((p1 + p2) / 2 - p1 * p2 / pa) AS ari, greatest(0.0, 2 * (h1 + h2 - hb) / (h1 + h2)) AS nmi FROM sm", "ari nmi")
def ari_nmi(spark, d):
    return Q.similarity(_cont(spark, d))


@query("reproduction_gate", _CONT, "SELECT g, true AS identical FROM cont GROUP BY g")
def reproduction_gate(spark, d):
    """Exactness gate: a run against itself under other label names must score 1 everywhere."""
    x = B.runs_e(spark, d).select(F.col("run").alias("g"), F.col("label").alias("ref"), (F.col("label") * 7 + 3).alias("cand"))
    return Q.similarity(Q.contingency(x)).select("g", ((F.abs(F.col("ari") - 1) < 1e-12) & (F.abs(F.col("nmi") - 1) < 1e-12)).alias("identical"))


@query("crosswalk_dominant", _CONT, "SELECT * REPLACE (CAST(size AS BIGINT) AS size) FROM cw", "retention entropy_bits")
def crosswalk_dominant(spark, d):
    return Q.crosswalk(_cont(spark, d))


@query("crosswalk_long", _CONT, "SELECT g, ref, cand, n, n / nr AS share, dominant, retention FROM m JOIN cw USING (g, ref)", "share retention")
def crosswalk_long(spark, d):
    return Q.crosswalk_long(_cont(spark, d))


@query("nestedness", _CONT, "SELECT g, sum(retention * size) / sum(size) AS micro_purity, avg(retention) AS macro_purity, min(retention) AS least_retention, avg((retention >= 0.5)::INT) AS share_50, avg((retention >= 0.8)::INT) AS share_80, avg((retention >= 0.95)::INT) AS share_95 FROM cw GROUP BY g", "micro_purity macro_purity least_retention share_50 share_80 share_95")
def nestedness(spark, d):
    return Q.nestedness(_cont(spark, d))


@query("pairwise_agreement", _PAIRS, "SELECT g, CAST(pb AS BIGINT) AS both_pairs, pb / p1 AS retention, pb / p2 AS precision FROM sm", "retention precision")
def pairwise_agreement(spark, d):
    return Q.pair_agreement(_cont(spark, d))


_INFO = "SELECT g, h1 / ln(2) AS h_ref, h2 / ln(2) AS h_cand, (hb - h1) / ln(2) AS h_cand_given_ref, (hb - h2) / ln(2) AS h_ref_given_cand, (2 * hb - h1 - h2) / ln(2) AS vi, (2 * hb - h1 - h2) / ln(total) AS vi_share FROM sm"


@query("information_bits", _PAIRS, _INFO, "h_ref h_cand h_cand_given_ref h_ref_given_cand vi vi_share")
def information_bits(spark, d):
    return Q.information(_cont(spark, d))


@query("structural_metrics", _PAIRS, f"SELECT g, (pb - p1 * p2 / pa) / ((p1 + p2) / 2 - p1 * p2 / pa) AS ari, micro_purity, pb / p1 AS retention, vi FROM sm JOIN (SELECT g, sum(retention * size) / sum(size) AS micro_purity FROM cw GROUP BY g) USING (g) JOIN ({_INFO}) USING (g)", "ari micro_purity retention vi")
def structural_metrics(spark, d):
    return Q.structural_metrics(_cont(spark, d)).select("g", "ari", "micro_purity", "retention", "vi")


@query("profile_diagnostics", _CONT, "SELECT g, ref, cand AS dominant, CAST(nr AS BIGINT) AS size, n / nr AS retention, n / nc AS precision, n / (nr + nc - n) AS jaccard, CASE WHEN nr = 1 THEN 1.0 ELSE (SELECT sum(n * (n - 1)) FROM cont z WHERE z.g = rk.g AND z.ref = rk.ref) / (nr * (nr - 1)) END AS within_pairs FROM rk WHERE place = 1", "retention precision jaccard within_pairs")
def profile_diagnostics(spark, d):
    return Q.profile_diagnostics(_cont(spark, d))


@query("cross_pair_coassign", _CONT, "SELECT a.g, a.ref AS a, b.ref AS b, sum(CASE WHEN a.cand = b.cand THEN a.n * b.n / (a.nr * b.nr) ELSE 0 END) AS together FROM m a JOIN m b ON a.g = b.g AND a.ref < b.ref GROUP BY ALL", "together")
def cross_pair_coassign(spark, d):
    return Q.cross_coassignment(_cont(spark, d))


@query("l2_crosswalk", _CONT, "SELECT g, ref, CASE WHEN n / nr >= 0.15 THEN CAST(cand AS VARCHAR) ELSE 'OTHER' END AS bucket, CAST(sum(n) AS BIGINT) AS n, sum(n / nr) AS share FROM m GROUP BY ALL", "share")
def l2_crosswalk(spark, d):
    """Destinations under 15 % of their class in one bucket."""
    c = Q.crosswalk_long(_cont(spark, d))
    return c.groupBy("g", "ref", F.when(F.col("share") >= 0.15, F.col("cand").cast("string")).otherwise("OTHER").alias("bucket")).agg(F.sum("n").alias("n"), F.sum("share").alias("share"))


@query("canonical_relabel", _CONT, "SELECT g, cand AS label, CAST(row_number() OVER (PARTITION BY g ORDER BY sum(n) DESC, cand) AS INTEGER) AS new, CAST(sum(n) AS BIGINT) AS n FROM cont GROUP BY g, cand")
def canonical_relabel(spark, d):
    return Q.canonical_relabel(B.runs_e(spark, d).select(F.col("run").alias("g"), "label"))


@query("state_table_wilson", RUNS_CTE, """SELECT family, n, changed, changed / n AS share, (p + z / (2 * n) - sqrt(z) * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n) AS low, (p + z / (2 * n) + sqrt(z) * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n) AS high
 FROM (SELECT family, count(*) AS n, count(*) FILTER (runs.label <> e.label) AS changed, count(*) FILTER (runs.label <> e.label) / count(*) AS p, 1.959963984540054 ** 2 AS z FROM runs JOIN e USING (i) GROUP BY family)""", "share low high")
def state_table_wilson(spark, d):
    ref = B.points_e(spark, d).select("i", F.col("label").alias("ref"))
    return Q.state_table(B.runs_e(spark, d).join(ref, "i").select("family", (F.col("label") != F.col("ref")).alias("changed")), ["family"])


@query("cross_lens_migration", RUNS_CTE + ", dm AS (SELECT label, modal FROM (SELECT runs.label, e.label AS modal, row_number() OVER (PARTITION BY runs.label ORDER BY count(*) DESC, e.label) AS p FROM runs JOIN e USING (i) WHERE run = 0 GROUP BY runs.label, e.label) WHERE p = 1)", "SELECT e.i, e.label AS ref, runs.label AS cand, modal, modal <> e.label AS reassigned FROM runs JOIN e USING (i) JOIN dm ON dm.label = runs.label WHERE run = 0")
def cross_lens_migration(spark, d):
    """Each unit's class against the dominant class of its cluster in the first run."""
    x = B.runs_e(spark, d).where("run = 0").join(B.points_e(spark, d).select("i", F.col("label").alias("ref")), "i").select("i", "ref", F.col("label").alias("cand"))
    modal = Q.dominant_label(x.select("cand", "ref"), ["cand"], "ref").select("cand", "modal")
    return x.join(modal, "cand").select("i", "ref", "cand", "modal", (F.col("modal") != F.col("ref")).alias("reassigned"))


_INDIV = RUNS_CTE + """, c AS (SELECT run, runs.label, e.label AS ref, count(*) AS n FROM runs JOIN e USING (i) GROUP BY ALL), cc AS (SELECT *, sum(n) OVER (PARTITION BY run, label) AS nc, sum(n) OVER (PARTITION BY run, ref) AS nr FROM c),
 ind AS (SELECT runs.i, e.label AS ref, avg(CASE WHEN nr > 1 THEN (n - 1) / (nr - 1) ELSE 1.0 END) AS peer, avg(n / nc) AS precision, avg(n / (nr + nc - n)) AS jaccard FROM runs JOIN e USING (i) JOIN cc ON cc.run = runs.run AND cc.label = runs.label AND cc.ref = e.label GROUP BY ALL)"""


@query("individual_stability", _INDIV, "SELECT * FROM ind", "peer precision jaccard")
def individual_stability(spark, d):
    return Q.individual_stability(B.runs_e(spark, d), B.points_e(spark, d).select("i", F.col("label").alias("ref")))


@query("method_agreement", RUNS_CTE + """, c AS (SELECT x.run AS a, y.run AS b, x.label AS l, y.label AS m, count(*) AS n FROM runs x JOIN runs y ON x.i = y.i AND x.run < y.run GROUP BY ALL),
 k AS (SELECT *, sum(n) OVER (PARTITION BY a, b, l) AS nl, sum(n) OVER (PARTITION BY a, b, m) AS nm, sum(n) OVER (PARTITION BY a, b) AS t FROM c), p AS (SELECT a, b, sum(n * (n - 1) / 2) AS pb, sum((n / t) * ln(n * t / (nl * nm))) AS mi, any_value(t) AS t FROM k GROUP BY a, b),
 q1 AS (SELECT a, b, sum(nl * (nl - 1) / 2) AS p, sum(-(nl / t) * ln(nl / t)) AS h FROM (SELECT DISTINCT a, b, l, nl, t FROM k) GROUP BY a, b), q2 AS (SELECT a, b, sum(nm * (nm - 1) / 2) AS p, sum(-(nm / t) * ln(nm / t)) AS h FROM (SELECT DISTINCT a, b, m, nm, t FROM k) GROUP BY a, b)""",
       "SELECT a, b, (pb - q1.p * q2.p / (t * (t - 1) / 2)) / ((q1.p + q2.p) / 2 - q1.p * q2.p / (t * (t - 1) / 2)) AS ari, greatest(0.0, 2 * mi / (q1.h + q2.h)) AS nmi FROM p JOIN q1 USING (a, b) JOIN q2 USING (a, b)", "ari nmi")
def method_agreement(spark, d):
    return Q.run_agreement(B.runs_e(spark, d))


@query("temporal_diagnostics", LABELS_CTE + """, mv AS (SELECT b.t, a.label AS ref, b.label AS cand FROM lab a JOIN lab b ON a.i = b.i AND b.t = a.t + 1), c AS (SELECT t, ref, cand, count(*) AS n FROM mv GROUP BY ALL),
 k AS (SELECT *, sum(n) OVER (PARTITION BY t, ref) AS nl, sum(n) OVER (PARTITION BY t, cand) AS nm, sum(n) OVER (PARTITION BY t) AS z FROM c), p AS (SELECT t, sum(n * (n - 1) / 2) AS pb, any_value(z) AS z, sum(CASE WHEN ref = cand THEN n ELSE 0 END) / any_value(z) AS same_share FROM k GROUP BY t),
 q1 AS (SELECT t, sum(nl * (nl - 1) / 2) AS p FROM (SELECT DISTINCT t, ref, nl FROM k) GROUP BY t), q2 AS (SELECT t, sum(nm * (nm - 1) / 2) AS p FROM (SELECT DISTINCT t, cand, nm FROM k) GROUP BY t)""",
       "SELECT t, (pb - q1.p * q2.p / (z * (z - 1) / 2)) / ((q1.p + q2.p) / 2 - q1.p * q2.p / (z * (z - 1) / 2)) AS ari, same_share FROM p JOIN q1 USING (t) JOIN q2 USING (t)", "ari same_share")
def temporal_diagnostics(spark, d):
    return Q.temporal_diagnostics(B.labels_by_t(spark, d)).drop("nmi")


@query("switch_counts", LABELS_CTE, "SELECT i, CAST(sum(s) AS BIGINT) AS switches FROM (SELECT i, CASE WHEN label <> lag(label) OVER (PARTITION BY i ORDER BY t) THEN 1 ELSE 0 END AS s FROM lab) GROUP BY i")
def switch_counts(spark, d):
    return Q.switches(B.labels_by_t(spark, d))


@query("halfyear_flows", LABELS_CTE, "SELECT a.t, a.label AS src, b.label AS dst, count(*) AS n FROM lab a JOIN lab b ON a.i = b.i AND b.t = a.t + 1 GROUP BY ALL")
def halfyear_flows(spark, d):
    return Q.flows(B.labels_by_t(spark, d))


@query("canonical_by_last", LABELS_CTE, "SELECT label, count(*) FILTER (t = 9) AS n_last, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE WHEN count(*) FILTER (t = 9) > 0 THEN 0 ELSE 1 END, count(*) FILTER (t = 9) DESC, count(*) DESC, label) AS INTEGER) AS new FROM lab GROUP BY label")
def canonical_by_last(spark, d):
    return Q.canonical_by_last(B.labels_by_t(spark, d))


@query("modal_label", LABELS_CTE, "SELECT i, label AS modal, n, n / 10 AS share FROM (SELECT i, label, count(*) AS n, row_number() OVER (PARTITION BY i ORDER BY count(*) DESC, label) AS p FROM lab GROUP BY i, label) WHERE p = 1", "share")
def modal_label(spark, d):
    return Q.dominant_label(B.labels_by_t(spark, d), ["i"], "label")


@query("cluster_sizes_json", _CONT, "SELECT g, '{' || string_agg('\"' || cand || '\":' || n, ',' ORDER BY cand) || '}' AS sizes FROM (SELECT g, cand, sum(n) AS n FROM cont GROUP BY ALL) GROUP BY g")
def cluster_sizes_json(spark, d):
    n = B.runs_e(spark, d).groupBy(F.col("run").alias("g"), "label").agg(F.count("*").alias("n"))
    return n.groupBy("g").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))).alias("sizes"))


# validity ------------------------------------------------------------------------------------------------

_SIL = E_CTE + """, pr AS (SELECT a.i, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM e a JOIN e b ON a.i <> b.i GROUP BY ALL),
 sl AS (SELECT i, label, max(CASE WHEN other = label THEN m END) AS a, min(CASE WHEN other <> label THEN m END) AS b FROM pr GROUP BY i, label)"""


@query("silhouette_points", _SIL, "SELECT i, label, a, b, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM sl", "a b s")
def silhouette_points(spark, d):
    return V.silhouettes(B.points_e(spark, d)).drop("g")


@query("silhouette", _SIL, "SELECT avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM sl", "silhouette")
def silhouette(spark, d):
    return V.silhouette(B.points_e(spark, d)).drop("g")


_LONG = E_CTE + ", x AS (SELECT i, label, unnest(v) AS x, unnest(range(64)) AS dim FROM e), ce AS (SELECT label, dim, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY ALL), al AS (SELECT dim, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY dim)"


@query("calinski_harabasz", _LONG, "SELECT (sum(n * (ce.m - al.m) ** 2) / ((SELECT count(DISTINCT label) FROM e) - 1)) / (sum(n * ce.v) / ((SELECT count(*) FROM e) - (SELECT count(DISTINCT label) FROM e))) AS calinski_harabasz FROM ce JOIN al USING (dim)", "calinski_harabasz")
def calinski_harabasz(spark, d):
    return V.calinski_harabasz(B.points_e(spark, d)).drop("g")


def _sdbw_sql(term: str, radius: str, inside: str, rule: str) -> tuple[str, str]:
    cte = _LONG + f""", cv AS (SELECT label, list(m ORDER BY dim) AS c, sqrt(sum({term.format('v')})) AS sd FROM ce GROUP BY label), k AS (SELECT count(*) AS k, avg(sd) AS sd_mean, {radius} AS r FROM cv),
 pp AS (SELECT a.label AS la, b.label AS lb, a.c AS ca, b.c AS cb, list_transform(list_zip(a.c, b.c), lambda z: (z[1] + z[2]) / 2) AS mid FROM cv a JOIN cv b ON a.label < b.label),
 dn AS (SELECT la, lb, count(*) FILTER (list_distance(e.v, mid) {inside} r) AS dm, greatest(count(*) FILTER (e.label = la AND list_distance(e.v, ca) {inside} r), count(*) FILTER (e.label = lb AND list_distance(e.v, cb) {inside} r)) AS top FROM pp JOIN e ON e.label IN (la, lb), k GROUP BY la, lb),
 ra AS (SELECT *, {rule} AS ratio FROM dn)"""
    sql = f"SELECT k, sd_mean / (SELECT sqrt(sum({term.format('v')})) FROM al) AS scatter, CASE WHEN und = 0 THEN mean END AS density, CASE WHEN und = 0 THEN sd_mean / (SELECT sqrt(sum({term.format('v')})) FROM al) + mean END AS s_dbw, und AS undefined_pairs, zp AS zero_pairs FROM k, (SELECT avg(ratio) AS mean, count(*) FILTER (ratio IS NULL) AS und, count(*) FILTER (top = 0 AND dm = 0) AS zp FROM ra)"
    return cte, sql


_S1 = _sdbw_sql("{0}", "avg(sd)", "<=", "CASE WHEN top > 0 THEN dm / top WHEN dm = 0 THEN 0.0 END")
_S2 = _sdbw_sql("{0} * {0}", "sqrt(sum(sd)) / count(*)", "<=", "CASE WHEN top > 0 THEN dm / top END")
_S3 = _sdbw_sql("{0}", "avg(sd)", ">", "dm / greatest(top, 1)")


@query("s_dbw", *_S1, "scatter density s_dbw")
def s_dbw(spark, d):
    return V.s_dbw(B.points_e(spark, d)).drop("g")


@query("s_dbw_variance_variant", *_S2, "scatter density s_dbw")
def s_dbw_variance_variant(spark, d):
    return V.s_dbw(B.points_e(spark, d), spread="var", radius="root", zero="undefined").drop("g")


@query("s_dbw_trace_outside", *_S3, "scatter density s_dbw")
def s_dbw_trace_outside(spark, d):
    return V.s_dbw(B.points_e(spark, d), inside=False, zero="floor").drop("g")


def _blocks_sql(weight: str) -> tuple[str, str]:
    cte = GRAPH_E_CTE + f""", bm AS MATERIALIZED (SELECT a.label AS ci, b.label AS cj, sum({weight}) AS s FROM both_ways w JOIN e a ON a.i = w.i JOIN e b ON b.i = w.j GROUP BY ALL),
 rw AS (SELECT ci AS c, sum(s) AS total, coalesce(sum(CASE WHEN ci = cj THEN s END), 0) AS own, sum(s) - coalesce(sum(CASE WHEN ci = cj THEN s END), 0) AS ext FROM bm GROUP BY ci),
 i1 AS (SELECT count(*) AS k, avg(own / total) AS avi, sum(CASE WHEN own > 0 THEN (own / 2) / (own / 2 + ext / 2) ELSE 0 END) AS turbo_mq FROM rw), i2 AS (SELECT sum(s / (a.ext + b.ext - s)) AS u FROM bm JOIN rw a ON a.c = ci JOIN rw b ON b.c = cj WHERE ci <> cj)"""
    return cte, "SELECT k, avi, u / k AS avu, turbo_mq, 1 / (u / k + 1 / avi) AS anui FROM i1, i2"


def _block_graph(spark, d, weighted):
    edges = G.knn_graph(B.near_e(spark, d))
    return V.block_indices(G.block_matrix(edges, B.points_e(spark, d).select("g", "i", "label"), weighted)).drop("g")


@query("avi_avu_weighted", *_blocks_sql("weight"), "avi avu turbo_mq anui")
def avi_avu_weighted(spark, d):
    return _block_graph(spark, d, True)


@query("avi_avu_unweighted", *_blocks_sql("1.0"), "avi avu turbo_mq anui")
def avi_avu_unweighted(spark, d):
    return _block_graph(spark, d, False)


_MOD = GRAPH_E_CTE + ", mc AS (SELECT a.label AS c, sum(weight) AS k, sum(CASE WHEN a.label = b.label THEN weight ELSE 0 END) AS w FROM both_ways x JOIN e a ON a.i = x.i JOIN e b ON b.i = x.j GROUP BY 1)"


@query("modularity_q", _MOD, "SELECT sum(w / (SELECT sum(k) FROM mc) - (k / (SELECT sum(k) FROM mc)) ** 2) AS modularity FROM mc", "modularity")
def modularity_q(spark, d):
    return V.modularity(G.knn_graph(B.near_e(spark, d)), B.points_e(spark, d).select("g", "i", "label")).drop("g")


@query("modularity_half_resolution", _MOD, "SELECT sum(w / (SELECT sum(k) FROM mc) - 0.5 * (k / (SELECT sum(k) FROM mc)) ** 2) AS modularity FROM mc", "modularity")
def modularity_half_resolution(spark, d):
    return V.modularity(G.knn_graph(B.near_e(spark, d)), B.points_e(spark, d).select("g", "i", "label"), 0.5).drop("g")


@query("icvi_flat", _blocks_sql("weight")[0] + ", mc AS (SELECT a.label AS c, sum(weight) AS k, sum(CASE WHEN a.label = b.label THEN weight ELSE 0 END) AS w FROM both_ways x JOIN e a ON a.i = x.i JOIN e b ON b.i = x.j GROUP BY 1)", "SELECT k, avi, u / k AS avu, 1 / (u / k + 1 / avi) AS anui, turbo_mq, (SELECT sum(w / (SELECT sum(k) FROM mc) - (k / (SELECT sum(k) FROM mc)) ** 2) FROM mc) AS modularity, 'ok' AS status FROM i1, i2", "avi avu anui turbo_mq modularity")
def icvi_flat(spark, d):
    pts = B.points_e(spark, d)
    return V.evaluate(pts, G.knn_graph(B.near_e(spark, d)), with_silhouette=False).drop("g", "calinski_harabasz", "s_dbw")


@query("icvi_undefined", "", "SELECT 0 AS g, CAST(NULL AS DOUBLE) AS value, 'undefined:single_cluster' AS status")
def icvi_undefined(spark, d):
    """One cluster only: the metric record is null with its reason."""
    one = B.points_e(spark, d).withColumn("label", F.lit(1).cast("bigint"))
    k = V.calinski_harabasz(one)
    rec = C.metric(F.col("calinski_harabasz"), F.when(F.col("calinski_harabasz").isNull(), "single_cluster"))
    return k.select("g", rec.alias("m")).select("g", "m.value", "m.status")


# consensus ------------------------------------------------------------------------------------------------------

_CO = RUNS_CTE + ", co AS MATERIALIZED (SELECT a.family, a.i, b.i AS j, count(*) / 3 AS p FROM runs a JOIN runs b ON a.run = b.run AND a.label = b.label AND a.i < b.i GROUP BY ALL)"


def _co(spark, d):
    return S.coassignment(B.runs_e(spark, d), B.points_e(spark, d).select("i"))


@query("coassignment_pairs", _CO, "SELECT * FROM co", "p")
def coassignment_pairs(spark, d):
    """Co-assignment of all pairs of units, within and across profiles."""
    return _co(spark, d)


@query("family_balanced_consensus", _CO, "SELECT i, j, sum(p) / 4 AS p FROM co GROUP BY i, j", "p")
def family_balanced_consensus(spark, d):
    """The consensus over all units, each family with equal weight."""
    return S.consensus(B.runs_e(spark, d), B.points_e(spark, d).select("i"), B.FAMILIES)


# affinity straight from the definition: mean co-assignment with the other members of a class
_AFF = RUNS_CTE + """, fa AS MATERIALIZED (SELECT a.family, a.i, b.cls, sum((a.label = b.label)::INT) / count(*) AS affinity FROM runs a JOIN (SELECT runs.*, e.label AS cls FROM runs JOIN e USING (i)) b ON a.run = b.run AND a.i <> b.i GROUP BY ALL),
 af AS MATERIALIZED (SELECT i, cls, avg(affinity) AS affinity FROM fa GROUP BY ALL), sh AS MATERIALIZED (SELECT *, affinity / sum(affinity) OVER (PARTITION BY i) AS share, row_number() OVER (PARTITION BY i ORDER BY round(affinity, 9) DESC, cls) AS place FROM af),
 mb AS MATERIALIZED (SELECT i, max(CASE WHEN place = 1 THEN cls END) AS best, max(CASE WHEN place = 2 THEN cls END) AS second, max(CASE WHEN place = 1 THEN share END) AS best_share, max(CASE WHEN place = 2 THEN share END) AS second_share, sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END) / ln(count(*)) AS entropy FROM sh GROUP BY i)"""


def _members(spark, d):
    return B.points_e(spark, d).select("i", F.col("label").alias("cls"))


def _fam(spark, d):
    return S.family_affinities(B.runs_e(spark, d), _members(spark, d))


@query("family_affinity", _AFF, "SELECT * FROM fa", "affinity")
def family_affinity(spark, d):
    return _fam(spark, d)


@query("profile_affinity", _AFF, "SELECT i, cls, affinity, share FROM sh", "affinity share")
def profile_affinity(spark, d):
    return S.affinities(_fam(spark, d))


@query("affinity_rank_entropy", _AFF, "SELECT i, best_share, second_share, best_share - second_share AS margin, entropy, 'resolved' AS status FROM mb", "best_share second_share margin entropy")
def affinity_rank_entropy(spark, d):
    return S.membership(S.affinities(_fam(spark, d))).drop("best", "second")


@query("family_votes", _AFF, "SELECT i, count(*) FILTER (l - r > 1e-9) AS \"left\", count(*) FILTER (r - l > 1e-9) AS \"right\" FROM (SELECT family, i, max(CASE WHEN cls = 1 THEN affinity END) AS l, max(CASE WHEN cls = 2 THEN affinity END) AS r FROM fa GROUP BY ALL) GROUP BY i")
def family_votes(spark, d):
    return S.family_votes(_fam(spark, d).withColumn("affinity", F.round("affinity", 9)), 1, 2)


@query("transition_direction", _AFF, "SELECT i, CASE WHEN r >= 3 THEN 'A->B' WHEN l >= 3 THEN 'B->A' ELSE 'A-B-middle' END AS direction FROM (SELECT i, count(*) FILTER (l - r > 1e-9) AS l, count(*) FILTER (r - l > 1e-9) AS r FROM (SELECT family, i, max(CASE WHEN cls = 1 THEN affinity END) AS l, max(CASE WHEN cls = 2 THEN affinity END) AS r FROM fa GROUP BY ALL) GROUP BY i)")
def transition_direction(spark, d):
    v = S.family_votes(_fam(spark, d).withColumn("affinity", F.round("affinity", 9)), 1, 2)
    return v.select("i", C.transition_direction(F.col("left"), F.col("right"), "A", "B").alias("direction"))


@query("affinity_balance", _AFF, "SELECT i, CASE WHEN l + r > 0 THEN (l - r) / (l + r) ELSE 0.0 END AS balance FROM (SELECT i, max(CASE WHEN cls = 1 THEN share END) AS l, max(CASE WHEN cls = 2 THEN share END) AS r FROM sh GROUP BY i)", "balance", 8)
def affinity_balance(spark, d):
    w = S.affinities(_fam(spark, d)).groupBy("i").agg(F.max(F.when(F.col("cls") == 1, F.col("share"))).alias("l"), F.max(F.when(F.col("cls") == 2, F.col("share"))).alias("r"))
    return w.select("i", C.balance(F.col("l"), F.col("r")).alias("balance"))


@query("lofo_entropy", _AFF + """, lf AS (SELECT o.family AS omitted, fa.i, cls, avg(affinity) AS affinity FROM fa, (SELECT DISTINCT family FROM fa) o WHERE fa.family <> o.family GROUP BY ALL), ls AS (SELECT *, affinity / sum(affinity) OVER (PARTITION BY omitted, i) AS share FROM lf)""", "SELECT omitted, i, max(share) AS best_share, sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END) / ln(count(*)) AS entropy FROM ls GROUP BY omitted, i", "best_share entropy")
def lofo_entropy(spark, d):
    return S.leave_one_family_out(_fam(spark, d)).select("omitted", "i", "best_share", "entropy")


@query("lofo_summary", RUNS_CTE, "SELECT DISTINCT family AS omitted, (SELECT count(*) FROM e) AS n FROM runs")
def lofo_summary(spark, d):
    f = _fam(spark, d)
    return S.lofo_summary(S.leave_one_family_out(f), S.membership(S.affinities(f))).select("omitted", "n")


_ANCHORS = _AFF + """, rd AS (SELECT i, cls, round(affinity, 9) AS affinity, share FROM sh), tp AS (SELECT i, arg_min(cls, (-affinity, cls)) AS best, arg_min(share, (-affinity, cls)) AS best_share FROM rd GROUP BY i),
 an AS MATERIALIZED (SELECT i, cls FROM (SELECT tp.i, e.label AS cls, row_number() OVER (PARTITION BY e.label ORDER BY round(best_share, 9) DESC, tp.i) AS place, count(*) OVER (PARTITION BY e.label) AS n FROM tp JOIN e ON e.i = tp.i AND e.label = tp.best) WHERE place <= greatest(2, ceil(n * 0.2)))"""


def _anchors(spark, d):
    f = S.affinities(_fam(spark, d)).withColumn("affinity", F.round("affinity", 9))
    return S.core_anchors(S.membership(f), _members(spark, d))


@query("core_anchors", _ANCHORS, "SELECT i, cls FROM an")
def core_anchors(spark, d):
    """Top fifth of each class by share, ties at nine digits by id."""
    return _anchors(spark, d)


_TO_ANCHORS = _ANCHORS + """, pa AS (SELECT a.family, a.i, b.cls, sum((a.label = b.label AND a.i <> b.i)::INT) AS hit, count(*) FILTER (a.i <> b.i) AS n FROM runs a JOIN (SELECT runs.run, runs.i, runs.label, an.cls FROM runs JOIN an USING (i)) b ON a.run = b.run GROUP BY ALL),
 fx AS (SELECT i, cls, avg(CASE WHEN n > 0 THEN hit / n ELSE 0.0 END) AS affinity FROM pa GROUP BY i, cls)"""


@query("anchor_affinity", _TO_ANCHORS, "SELECT i, cls, affinity, affinity / nullif(sum(affinity) OVER (PARTITION BY i), 0) AS share FROM fx", "affinity share")
def anchor_affinity(spark, d):
    """Affinities to the anchors of each class only."""
    return S.affinities(S.family_affinities(B.runs_e(spark, d), _anchors(spark, d)))


_CASES = _AFF + """, mg AS (SELECT mb.*, best_share - second_share AS margin FROM mb),
 md AS (SELECT label, dim, median(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS dim FROM e) GROUP BY ALL), ce AS (SELECT label, list(x ORDER BY dim) AS c FROM md GROUP BY label),
 cs AS (SELECT e.label AS cls, arg_min(e.i, (round(list_distance(v, c), 9), e.i)) AS core, arg_min(e.i, (-round(entropy, 9), e.i)) AS boundary, arg_min(e.i, (-round(margin, 9), e.i)) AS margin FROM e JOIN ce USING (label) JOIN mg ON mg.i = e.i GROUP BY e.label)"""


@query("case_selection", _CASES, "SELECT cls, 'core' AS kind, core AS i FROM cs UNION ALL SELECT cls, 'boundary', boundary FROM cs UNION ALL SELECT cls, 'margin', margin FROM cs")
def case_selection(spark, d):
    """The unit nearest its class's median centre, the one of largest entropy and the one of largest margin."""
    m = S.membership(S.affinities(_fam(spark, d))).select("i", "margin", "entropy")
    return S.select_cases(m, B.points_e(spark, d).select("i", F.col("label").alias("cls"), "vec"))


_ANALOG = GRAPH_E_CTE + """, runs AS (SELECT run, i, CAST((v[run*3+1] > 0)::INT * 4 + (v[run*3+2] > 0)::INT * 2 + (v[run*3+3] > 0)::INT AS BIGINT) AS label FROM e, (SELECT CAST(unnest(range(12)) AS INTEGER) AS run)),
 bw AS (SELECT src AS i, dst AS j, distance FROM edges UNION ALL SELECT dst, src, distance FROM edges), n3 AS (SELECT i, j, distance FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(distance, 9), j) AS p FROM bw) WHERE p <= 3)"""


@query("network_analogs", _ANALOG, "SELECT n3.i, n3.j, distance, avg((a.label = b.label)::INT) AS together FROM n3 JOIN runs a ON a.i = n3.i JOIN runs b ON b.i = n3.j AND b.run = a.run GROUP BY ALL", "distance together")
def network_analogs(spark, d):
    """Each unit's nearest graph neighbours with the share of runs that put both in one class."""
    return S.analogs(G.knn_graph(B.near_e(spark, d)), B.runs_e(spark, d))


@query("stability_state", _INDIV, """SELECT i, ref, CASE WHEN (SELECT count(*) FROM e z WHERE z.label = ind.ref) < 45 THEN 'unresolved' WHEN peer >= 0.12 AND precision >= 0.12 THEN 'over' ELSE 'under' END AS state FROM ind""")
def stability_state(spark, d):
    x = Q.individual_stability(B.runs_e(spark, d), B.points_e(spark, d).select("i", F.col("label").alias("ref")))
    n = B.points_e(spark, d).groupBy(F.col("label").alias("ref")).agg(F.count("*").alias("n"))
    return x.join(n, "ref").select("i", "ref", F.when(F.col("n") < 45, "unresolved").when((F.col("peer") >= 0.12) & (F.col("precision") >= 0.12), "over").otherwise("under").alias("state"))


@query("stability_atlas", _INDIV, """SELECT i, ref, CASE WHEN peer >= 0.85 AND precision >= 0.75 AND jaccard >= 0.65 THEN 'stable_core' WHEN peer >= 0.85 AND (precision < 0.75 OR jaccard < 0.65) THEN 'expansive_core' WHEN peer < 0.75 AND jaccard < 0.5 THEN 'transition' ELSE 'unresolved' END AS stability FROM ind""")
def stability_atlas(spark, d):
    x = Q.individual_stability(B.runs_e(spark, d), B.points_e(spark, d).select("i", F.col("label").alias("ref")))
    return S.stability(x, 2, B.points_e(spark, d).groupBy(F.col("label").alias("ref")).agg(F.count("*").alias("n")))
