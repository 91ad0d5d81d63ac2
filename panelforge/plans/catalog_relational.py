"""Joins, aggregates, windows and selections on plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..durable import stash
from ..functions import columns as C
from ..operators import panel as P
from ..operators import relational as R
from ..operators import windows as W
from ..session import read_table as T
from . import bindings as B
from .bindings import FEATURE_CTE, P_CTE, SUPPLIER_CTE
from .registry import query


@query("join_left_1to1", "", "SELECT s_suppkey AS k, s_acctbal AS balance, n_lines FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey")
def join_left_1to1(spark, d):
    a = T(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    b = T(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n_lines"))
    return R.checked_join(a, b, ["k"])


@query("join_left_many_to_one", "", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_many_to_one(spark, d):
    c = T(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    x = R.checked_join(c, T(spark, d, "nation"), ["n_nationkey"], validate="many_to_one").withColumnRenamed("n_regionkey", "r_regionkey")
    return R.checked_join(x, T(spark, d, "region"), ["r_regionkey"], validate="many_to_one").select("c_custkey", "n_name", "r_name")


@query("join_outer_fold", "", """WITH a AS (SELECT l_suppkey AS k, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 AND l_quantity > 45 GROUP BY 1), b AS (SELECT l_suppkey AS k, count(*) AS cheap FROM lineitem WHERE l_extendedprice < 1500 GROUP BY 1),
 c AS (SELECT s_suppkey AS k, s_acctbal AS rich FROM supplier WHERE s_acctbal > 5000) SELECT coalesce(a.k, b.k, c.k) AS k, returned, cheap, rich FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON c.k = coalesce(a.k, b.k)""")
def join_outer_fold(spark, d):
    x = T(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k")
    a = x.where("l_returnflag = 'R' and l_discount > 0.08 and l_quantity > 45").groupBy("k").agg(F.count("*").alias("returned"))
    b = x.where("l_extendedprice < 1500").groupBy("k").agg(F.count("*").alias("cheap"))
    c = T(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("rich"))
    return R.outer_fold([a, b, c], "k")


@query("join_indicator", "", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') THEN 'MATCHED' ELSE 'MISSING' END AS status FROM customer")
def join_indicator(spark, d):
    o = T(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return R.with_indicator(T(spark, d, "customer").select("c_custkey"), o, ["c_custkey"])


@query("join_two_key_compare", "", "WITH a AS (SELECT l_suppkey AS k, l_linenumber AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS k, l_linenumber AS n, sum(CASE WHEN l_suppkey % 10 = 0 THEN l_quantity + 1 ELSE l_quantity END) AS q FROM lineitem GROUP BY ALL) SELECT k, n, abs(a.q - b.q) AS difference, abs(a.q - b.q) <= 1e-9 AS same FROM a JOIN b USING (k, n)", "difference")
def join_two_key_compare(spark, d):
    x = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    a = x.groupBy("k", "n").agg(F.sum("q").alias("qa"))
    b = x.groupBy("k", "n").agg(F.sum(F.when(F.col("k") % 10 == 0, F.col("q") + 1).otherwise(F.col("q"))).alias("qb"))
    return R.checked_join(a, b, ["k", "n"], "inner").select("k", "n", F.abs(F.col("qa") - F.col("qb")).alias("difference"), (F.abs(F.col("qa") - F.col("qb")) <= 1e-9).alias("same"))


@query("lookup_map", "", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'basic' WHEN 'STANDARD' THEN 'basic' WHEN 'PROMO' THEN 'sale' END AS family FROM part")
def lookup_map(spark, d):
    m = F.create_map(*(F.lit(x) for x in ("ECONOMY", "basic", "STANDARD", "basic", "PROMO", "sale")))
    return T(spark, d, "part").select("p_partkey", F.element_at(m, F.col("p_type")).alias("family"))


@query("ordered_realignment", P_CTE + ", names AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS idx FROM whole)", "SELECT idx, unit, sum(value) AS total FROM names JOIN panel USING (unit) GROUP BY ALL", "total")
def ordered_realignment(spark, d):
    sp = P.strict_panel(B.cells(spark, d), categories=B.CATEGORIES, periods=B.PERIODS)
    return sp.units.join(sp.panel.groupBy("unit").agg(F.sum("value").alias("total")), "unit", "left").select("idx", "unit", "total").orderBy("idx")


@query("anti_missing_keys", "", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_missing_keys(spark, d):
    return T(spark, d, "customer").select("c_custkey").join(T(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("semi_known_keys", "", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def semi_known_keys(spark, d):
    return T(spark, d, "part").select("p_partkey").join(T(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("audited_join", "", "SELECT s_suppkey AS k, true AS nation_same, s_suppkey % 5 <> 0 AS band_same, s_suppkey % 5 <> 0 AS all_same FROM supplier")
def audited_join(spark, d):
    s = T(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("band"))
    return R.audited_join(s, s.withColumn("band", F.when(F.col("k") % 5 == 0, F.col("band") + 1).otherwise(F.col("band"))), "k", ["nation", "band"])


_LIN = P_CTE + ", cur AS (SELECT 'u' || unit AS mo, t, category, CAST(round(value) AS BIGINT) AS value FROM panel UNION ALL SELECT 'v' || unit, t, category, CAST(round(value) AS BIGINT) FROM panel WHERE unit % 10 = 0), off AS (SELECT unit + 1000 AS territory, t, category, CAST(round(value) AS BIGINT) + CASE WHEN unit % 7 = 0 AND t = 4 THEN 1 ELSE 0 END AS value FROM panel)"


def _lineage(spark, d):
    # written once, for both sides; sums that are n.5 go up or down with the order of their terms, so terms are added in the order of the files
    p = stash(P.complete_rows(B.cells_in_order(spark, d), B.CATEGORIES, len(B.PERIODS)).select("unit", "t", "category", F.round("value").cast("bigint").alias("value")))
    cur = p.select(F.concat(F.lit("u"), F.col("unit")).alias("mo"), "t", "category", "value").union(p.where("unit % 10 = 0").select(F.concat(F.lit("v"), F.col("unit")), "t", "category", "value"))
    off = p.select((F.col("unit") + 1000).alias("territory"), "t", "category", (F.col("value") + F.expr("case when unit % 7 = 0 and t = 4 then 1 else 0 end")).alias("value"))
    return cur, off


@query("lineage_fingerprint", _LIN, "SELECT mo, CASE WHEN CAST(substr(mo, 2) AS BIGINT) % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS candidates, CASE WHEN CAST(substr(mo, 2) AS BIGINT) % 7 <> 0 THEN CAST(substr(mo, 2) AS BIGINT) + 1000 END AS territory FROM (SELECT DISTINCT mo FROM cur)")
def lineage_fingerprint(spark, d):
    return R.exact_lineage(*_lineage(spark, d), "mo", "territory", ["t", "category", "value"])


@query("fingerprint_digest", _LIN, "SELECT mo, count(*) AS n, sha256(string_agg(concat_ws('|', t, category, value), chr(10) ORDER BY concat_ws('|', t, category, value))) AS digest FROM cur GROUP BY mo")
def fingerprint_digest(spark, d):
    return R.fingerprints(_lineage(spark, d)[0], "mo", ["t", "category", "value"])


@query("lineage_multiset_contains", _LIN, """SELECT territory, min(mo) AS mo FROM (SELECT territory, mo FROM (SELECT territory, t, category, value, count(*) AS need FROM off GROUP BY ALL) b JOIN (SELECT mo, t, category, value, count(*) AS have FROM cur GROUP BY ALL) a USING (t, category, value) WHERE have >= need GROUP BY territory, mo HAVING count(*) = 60) GROUP BY territory HAVING count(*) = 1""")
def lineage_multiset_contains(spark, d):
    return R.contained_lineage(*_lineage(spark, d), "mo", "territory", ["t", "category", "value"])


@query("multiset_equal", _LIN, "SELECT (SELECT count(*) FROM (SELECT t, category, value FROM cur EXCEPT ALL SELECT t, category, value FROM off)) AS only_left, (SELECT count(*) FROM (SELECT t, category, value FROM off EXCEPT ALL SELECT t, category, value FROM cur)) AS only_right, false AS equal")
def multiset_equal(spark, d):
    a, b = _lineage(spark, d)
    return R.multiset_equal(a.select("t", "category", "value"), b.select("t", "category", "value"))


@query("collapse_nonconflicting", "", """WITH x AS (SELECT o_custkey AS k, o_orderstatus AS v, o_orderpriority AS nm FROM orders WHERE o_totalprice > 300000), g AS (SELECT k, count(DISTINCT v) AS vs, count(DISTINCT nm) AS ns, min(v) AS v0, min(nm) AS n0 FROM x GROUP BY k)
 SELECT k, CASE WHEN vs = 1 AND ns = 1 THEN v0 END AS v, CASE WHEN vs = 1 AND ns = 1 THEN n0 END AS nm, CASE WHEN vs = 1 AND ns = 1 THEN 'accepted' WHEN vs = 0 THEN 'no_value' WHEN vs > 1 THEN 'value_conflict' ELSE 'name_conflict' END AS status FROM g""")
def collapse_nonconflicting(spark, d):
    x = T(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderpriority").alias("nm"))
    return R.collapse_agreeing(x, "k", "v", "nm")


@query("code_transform_gate", "", """WITH x AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN '12-34' ELSE lpad(CAST(CASE WHEN s_suppkey % 9 = 0 THEN 9 ELSE s_suppkey END AS VARCHAR), 8, '0') || '-' || CASE WHEN s_suppkey % 4 = 0 THEN '101' ELSE '000' END END AS code FROM supplier),
 y AS (SELECT k, replace(code, '-', '') AS p FROM x), z AS (SELECT k, p, CASE WHEN regexp_matches(p, '^[0-9]{11}$') AND p LIKE '%000' THEN substr(p, 1, 8) END AS c8 FROM y), w AS (SELECT *, count(c8) OVER (PARTITION BY c8) AS claims, c8 IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') FROM supplier WHERE s_suppkey % 6 <> 0) AS known FROM z),
 q AS (SELECT k, c8, CASE WHEN p IS NULL THEN 'missing' WHEN NOT regexp_matches(p, '^[0-9]{11}$') THEN 'not_11_digits' WHEN NOT p LIKE '%000' THEN 'not_a_whole_unit' WHEN NOT known THEN 'unknown_code' WHEN claims > 1 THEN 'many_to_one_conflict' ELSE 'ok' END AS reason FROM w) SELECT k, CASE WHEN reason = 'ok' THEN c8 END AS code8, reason FROM q""")
def code_transform_gate(spark, d):
    k = F.col("k")
    body = F.concat(F.lpad(F.when(k % 9 == 0, 9).otherwise(k).cast("string"), 8, "0"), F.lit("-"), F.when(k % 4 == 0, "101").otherwise("000"))
    codes = T(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).withColumn("code", F.when(k % 11 == 0, None).when(k % 13 == 0, "12-34").otherwise(body))
    known = T(spark, d, "supplier").where("s_suppkey % 6 <> 0").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("c8"))
    return R.code_11_to_8(codes, "k", "code", known)


@query("crosswalk_override", "", """WITH nm AS (SELECT n_name AS name, lower(n_name) AS normal, n_nationkey AS k FROM nation), en AS (SELECT lower(n_name) AS normal FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT lower(n_name) FROM nation WHERE n_nationkey % 5 = 0)
 SELECT name, (SELECT count(*) FROM en WHERE en.normal = nm.normal) AS candidates, CASE WHEN k % 7 = 0 THEN k END AS entity, CASE WHEN k % 7 = 0 THEN 'override' WHEN (SELECT count(*) FROM en WHERE en.normal = nm.normal) = 0 THEN 'blocked_no_candidate' WHEN (SELECT count(*) FROM en WHERE en.normal = nm.normal) = 1 THEN 'blocked_unreviewed' ELSE 'blocked_ambiguous' END AS status FROM nm""")
def crosswalk_override(spark, d):
    n = T(spark, d, "nation").select(F.col("n_name").alias("name"), C.normal_name(F.col("n_name")).alias("normal"), F.col("n_nationkey").alias("k"))
    entities = n.where("k % 3 <> 0").select("normal").union(n.where("k % 5 = 0").select("normal"))
    return R.conservative_crosswalk(n.select("name", "normal"), entities, n.where("k % 7 = 0").select("name", F.col("k").alias("entity")))


@query("unpivot_provenance", "", """SELECT s_suppkey AS k, indicator, value, CASE indicator WHEN 'balance' THEN 'ledger' ELSE 'unknown' END AS source FROM (SELECT s_suppkey, 'balance' AS indicator, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier) WHERE value IS NOT NULL""", "value")
def unpivot_provenance(spark, d):
    s = T(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("case when s_acctbal > 0 then s_acctbal end").alias("balance"), F.col("s_nationkey").alias("nation"))
    return R.provenance(s, "k", ["balance", "nation"], spark.createDataFrame([("balance", "ledger")], "indicator string, source string"))


@query("coverage_audit", "", """WITH x AS (SELECT c_custkey AS k, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AS hit FROM customer) SELECT count(*) AS n, count(*) FILTER (hit) AS covered, count(*) FILTER (hit) / count(*) AS share, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT CAST(k AS VARCHAR) AS s FROM x WHERE NOT hit ORDER BY k LIMIT 20)) AS missing FROM x""", "share")
def coverage_audit(spark, d):
    """The list of missing keys is a report of the first twenty."""
    o = T(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    return R.coverage(o, T(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("identity_first_non_empty", "", "SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE nullif(trim(c_mktsegment), '') END, c_name) AS identity, CASE WHEN c_custkey % 3 <> 0 AND nullif(trim(c_mktsegment), '') IS NOT NULL THEN 'seg' ELSE 'c_name' END AS identity_source FROM customer")
def identity_first_non_empty(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("case when c_custkey % 3 = 0 then ' ' else c_mktsegment end").alias("seg"), "c_name")
    return R.first_non_empty(c, ["seg", "c_name"]).select("k", "identity", "identity_source")


@query("dummy_encoding", "", "SELECT p_partkey, (p_type = 'LARGE')::INT AS p_type_LARGE, (p_type = 'MEDIUM')::INT AS p_type_MEDIUM, (p_type = 'PROMO')::INT AS p_type_PROMO, (p_type = 'SMALL')::INT AS p_type_SMALL, (p_type = 'STANDARD')::INT AS p_type_STANDARD FROM part")
def dummy_encoding(spark, d):
    return R.dummies(T(spark, d, "part"), "p_partkey", "p_type", B.CATEGORIES)


@query("tolerance_gate", "", "SELECT o_orderpriority AS k, avg(o_totalprice) AS actual, avg(o_totalprice) * CASE WHEN o_orderpriority = '1-URGENT' THEN 1.1 ELSE 1.0 END AS expected, o_orderpriority <> '1-URGENT' AS ok FROM orders GROUP BY 1", "actual expected")
def tolerance_gate(spark, d):
    a = T(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg("o_totalprice").alias("value"))
    return R.within_tolerance(a, a.withColumn("value", F.col("value") * F.when(F.col("k") == "1-URGENT", 1.1).otherwise(1.0)), ["k"], 1e-6)


@query("union_ragged", "", "SELECT s_suppkey AS k, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def union_ragged(spark, d):
    a = T(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("set_operations", "", "SELECT 'both' AS part, count(*) AS n FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT 'left_only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)")
def set_operations(spark, d):
    a, b = T(spark, d, "customer").select(F.col("c_nationkey").alias("k")), T(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").union(count(a.subtract(b), "left_only")).union(count(a.union(b).distinct(), "either"))


# aggregates ------------------------------------------------------------------------------------------

@query("group_size", "", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def group_size(spark, d):
    return T(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("count_distinct", "", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def count_distinct(spark, d):
    return T(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("named_multi_agg", "", "SELECT l_suppkey, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.1) AS q10, min(l_extendedprice) AS least, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 100", "mean q10 least", 4)
def named_multi_agg(spark, d):
    x = T(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("mean"), F.percentile("l_extendedprice", 0.1).alias("q10"), F.min("l_extendedprice").alias("least"), F.count_distinct("l_orderkey").alias("orders"), F.count("*").alias("_n"))
    return x.where("_n >= 100").drop("_n")


@query("distribution_record", "", "SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, median(l_extendedprice) AS median, coalesce(stddev_samp(l_extendedprice), 0) AS sd, min(l_extendedprice) AS least, max(l_extendedprice) AS most, quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY 1", "mean median sd least most q10 q90", 4)
def distribution_record(spark, d):
    x = "l_extendedprice"
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"), F.percentile(x, 0.1).alias("q10"), F.percentile(x, 0.9).alias("q90"))


@query("boolean_aggregate", "", "SELECT l_suppkey, count(*) AS n, CAST(sum((l_discount > 0.05)::INT) AS BIGINT) AS hits, avg((l_discount > 0.05)::INT) AS share FROM lineitem GROUP BY 1", "share")
def boolean_aggregate(spark, d):
    hit = (F.col("l_discount") > 0.05).cast("int")
    return T(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("share"))


@query("modal_value", "", "SELECT c_nationkey, c_mktsegment AS modal, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS p FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE p = 1")
def modal_value(spark, d):
    from ..operators.partitions import dominant_label

    return dominant_label(T(spark, d, "customer"), ["c_nationkey"], "c_mktsegment").select("c_nationkey", "modal", "n")


@query("crosstab", "", "SELECT p_type, count(*) FILTER (p_size <= 10) AS small, count(*) FILTER (p_size > 10 AND p_size <= 30) AS medium, count(*) FILTER (p_size > 30) AS large FROM part GROUP BY 1")
def crosstab(spark, d):
    band = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large").alias("band")
    return T(spark, d, "part").select("p_type", band).groupBy("p_type").pivot("band", ["small", "medium", "large"]).agg(F.count(F.lit(1))).na.fill(0)


@query("rollup_map_sum", "", "SELECT l_suppkey, sum(CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN l_quantity ELSE 0 END) AS basic, sum(CASE WHEN p_type = 'PROMO' THEN l_quantity ELSE 0 END) AS sale FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1", "basic sale")
def rollup_map_sum(spark, d):
    """Codes rolled up to sectors by a map, summed and spread."""
    m = F.create_map(*(F.lit(x) for x in ("ECONOMY", "basic", "STANDARD", "basic", "PROMO", "sale")))
    x = T(spark, d, "lineitem").join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("sector", F.element_at(m, F.col("p_type")))
    return x.groupBy("l_suppkey").pivot("sector", ["basic", "sale"]).agg(F.sum("l_quantity")).na.fill(0.0)


@query("monotone_medians", SUPPLIER_CTE, "SELECT band, median(wage) AS median, (SELECT median(wage) FROM sup WHERE band = 'high') > (SELECT median(wage) FROM sup WHERE band = 'mid') AND (SELECT median(wage) FROM sup WHERE band = 'mid') > (SELECT median(wage) FROM sup WHERE band = 'neg') AS monotone FROM sup GROUP BY band", "median", 4)
def monotone_medians(spark, d):
    m = B.suppliers(spark, d).groupBy("band").agg(F.median("wage").alias("median"))
    wide = m.groupBy().pivot("band", ["high", "mid", "neg"]).agg(F.first("median")).selectExpr("high > mid and mid > neg as monotone")
    return m.crossJoin(wide)


@query("typology_summary", SUPPLIER_CTE, "SELECT region, count(*) AS n, median(wage) AS median, quantile_cont(wage, 0.75) - quantile_cont(wage, 0.25) AS iqr FROM sup GROUP BY region", "median iqr", 4)
def typology_summary(spark, d):
    return B.suppliers(spark, d).groupBy("region").agg(F.count("*").alias("n"), F.median("wage").alias("median"), (F.percentile("wage", 0.75) - F.percentile("wage", 0.25)).alias("iqr"))


@query("top_sectors_text", P_CTE, "SELECT t, string_agg(category, ', ' ORDER BY place) AS top FROM (SELECT t, category, row_number() OVER (PARTITION BY t ORDER BY sum(value) DESC, category) AS place FROM panel GROUP BY t, category) WHERE place <= 3 GROUP BY t")
def top_sectors_text(spark, d):
    s = B.panel(spark, d).groupBy("t", "category").agg(F.sum("value").alias("v"))
    x = W.top_k(s, 3, ["t"], "v desc, category")
    return x.groupBy("t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "category"))), lambda r: r["category"]), ", ").alias("top"))


# windows and selections -----------------------------------------------------------------------------------

@query("rank_central", "", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal)) AS rank FROM customer")
def rank_central(spark, d):
    return T(spark, d, "customer").selectExpr("c_custkey", "cast(rank() over (partition by c_nationkey order by round(c_acctbal)) as bigint) as rank")


@query("pct_rank_max_desc", "", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -3) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY c_nationkey) AS pct FROM customer", "pct")
def pct_rank_max_desc(spark, d):
    x = T(spark, d, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", -3).alias("v"))
    return W.percentile_max_desc(x, "v", ["c_nationkey"]).select("c_custkey", "pct")


@query("avg_rank_ties", "", "SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2 AS rank FROM part", "rank")
def avg_rank_ties(spark, d):
    return W.average_rank(T(spark, d, "part"), "p_size", ["p_type"]).select("p_partkey", "rank")


@query("lag_diff", P_CTE, "SELECT unit, t, category, value - lag(value) OVER (PARTITION BY unit, category ORDER BY t) AS delta FROM panel", "delta")
def lag_diff(spark, d):
    return W.difference(B.panel(spark, d), "value", ["unit", "category"], "t").drop("value")


@query("yoy_diff", P_CTE, "SELECT unit, t, category, value - lag(value, 2) OVER (PARTITION BY unit, category ORDER BY t) AS delta FROM panel", "delta")
def yoy_diff(spark, d):
    return W.difference(B.panel(spark, d), "value", ["unit", "category"], "t", 2).drop("value")


@query("index_100", P_CTE, "SELECT unit, t, category, 100 * value / first_value(value) OVER (PARTITION BY unit, category ORDER BY t) AS index FROM panel", "index")
def index_100(spark, d):
    return W.index_to_first(B.panel(spark, d), "value", ["unit", "category"], "t").drop("value")


_PV = "pv AS (SELECT p_partkey AS k, p_type AS family, p_retailprice / 1000000 AS p FROM part)"


def _pvalues(spark, d):
    return T(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("family"), (F.col("p_retailprice") / 1000000).alias("p"))


@query("bh_adjust", _PV + ", r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, k) AS r, count(*) OVER (PARTITION BY family) AS n FROM pv)", "SELECT k, least(1.0, min(p * n / r) OVER (PARTITION BY family ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r", "q")
def bh_adjust(spark, d):
    return W.benjamini_hochberg(_pvalues(spark, d), "p", ["family"], "k").select("k", "q")


@query("holm_adjust", _PV + ", r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, k) AS r, count(*) OVER (PARTITION BY family) AS n FROM pv)", "SELECT k, least(1.0, max((n - r + 1) * p) OVER (PARTITION BY family ORDER BY r ROWS UNBOUNDED PRECEDING)) AS q FROM r", "q")
def holm_adjust(spark, d):
    return W.holm(_pvalues(spark, d), "p", ["family"], "k").select("k", "q")


@query("group_median_center", "", "SELECT c_custkey, c_acctbal - (SELECT median(z.c_acctbal) FROM customer z WHERE z.c_nationkey IS NOT DISTINCT FROM customer.c_nationkey) AS centred FROM customer", "centred")
def group_median_center(spark, d):
    return W.centre_on_median(T(spark, d, "customer"), "c_acctbal", ["c_nationkey"]).select("c_custkey", "centred")


@query("top3_neighbors", FEATURE_CTE + ", bw AS (SELECT g, src AS i, dst AS j, distance AS d FROM edges UNION ALL SELECT g, dst, src, distance FROM edges)", "SELECT g, i, j, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY d, j) AS place FROM bw) WHERE place <= 3")
def top3_neighbors(spark, d):
    from ..operators.graphs import knn_graph

    e = knn_graph(B.near_p(spark, d))
    two = e.select("g", F.col("src").alias("i"), F.col("dst").alias("j"), "distance").union(e.select("g", "dst", "src", "distance"))
    return W.top_k(two, 3, ["g", "i"], "distance, j").drop("distance")


@query("top_fraction_group", "", "SELECT c_custkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE place <= greatest(2, ceil(n * 0.1))")
def top_fraction_group(spark, d):
    return W.top_fraction(T(spark, d, "customer"), 0.1, ["c_nationkey"], "c_acctbal desc, c_custkey").select("c_custkey", "place")


@query("diversity_first", "", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 40")
def diversity_first(spark, d):
    """A report of forty rows: the limit is the feature."""
    return W.diversity_first(T(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice desc, o_orderkey", 40).select("o_orderkey")


@query("dedup_keep_first", "", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def dedup_keep_first(spark, d):
    return W.keep_first(T(spark, d, "orders"), ["o_custkey"], "o_totalprice desc, o_orderkey").select("o_custkey", "o_orderkey")


@query("argmax_by_rule", "", "SELECT l_returnflag, arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, l_orderkey * 10 + l_linenumber)) AS best FROM lineitem GROUP BY 1")
def argmax_by_rule(spark, d):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max_by(key, F.struct("l_extendedprice", key)).alias("best"))


@query("pareto_front", "", "SELECT p_partkey, NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice)) AS on_front FROM part a")
def pareto_front(spark, d):
    return W.pareto_front(T(spark, d, "part"), "p_partkey", "p_size", "p_retailprice").select("p_partkey", "on_front")


@query("mixed_sort_ranked", "", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_acctbal DESC, c_custkey) AS place FROM customer")
def mixed_sort_ranked(spark, d):
    return T(spark, d, "customer").selectExpr("c_custkey", "cast(row_number() over (partition by c_mktsegment order by c_nationkey, c_acctbal desc, c_custkey) as bigint) as place")


# text and geography -------------------------------------------------------------------------------------------

@query("name_normalize", "", r"SELECT p_partkey, trim(regexp_replace(replace(replace(lower('  Ёл-' || p_name || '—№' || p_brand), 'ё', 'е'), '№', 'no'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS name FROM part")
def name_normalize(spark, d):
    return T(spark, d, "part").select("p_partkey", C.normal_name(F.concat(F.lit("  Ёл-"), "p_name", F.lit("—№"), "p_brand")).alias("name"))


@query("admin_form_case", "", "SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'construction' WHEN contains(lower(c_mktsegment), 'auto') THEN 'vehicles' WHEN contains(lower(c_mktsegment), 'h') THEN 'home' ELSE 'other' END AS form FROM customer")
def admin_form_case(spark, d):
    return T(spark, d, "customer").select("c_custkey", C.first_match(F.col("c_mktsegment"), [("build", "construction"), ("auto", "vehicles"), ("h", "home")], "other").alias("form"))


@query("display_name", "", "SELECT c_custkey, CASE WHEN starts_with(lower(c_name), 'customer#') THEN upper(substr(trim(substr(c_name, 10)), 1, 1)) || substr(trim(substr(c_name, 10)), 2) ELSE upper(substr(trim(c_name), 1, 1)) || substr(trim(c_name), 2) END AS name FROM customer")
def display_name(spark, d):
    return T(spark, d, "customer").select("c_custkey", C.display_name(F.col("c_name"), ["customer#"]).alias("name"))


@query("regex_section", "", r"SELECT p_partkey, regexp_extract('Section ' || chr(CAST(65 + p_size % 26 AS INTEGER)) || ' ' || p_name, '^Section\s+([A-U])', 1) AS section FROM part")
def regex_section(spark, d):
    letter = F.char((F.lit(65) + F.col("p_size") % 26).cast("bigint"))
    return T(spark, d, "part").select("p_partkey", F.regexp_extract(F.concat(F.lit("Section "), letter, F.lit(" "), "p_name"), r"^Section\s+([A-U])", 1).alias("section"))


@query("text_bool", "", "SELECT c_custkey, c_custkey % 3 = 0 AS flag FROM customer")
def text_bool(spark, d):
    return T(spark, d, "customer").select("c_custkey", C.text_bool(F.expr("case when c_custkey % 3 = 0 then ' True' when c_custkey % 3 = 1 then 'no' end")).alias("flag"))


_LL = "ll AS (SELECT s_suppkey AS k, 20.0 + 6 * s_nationkey + s_suppkey % 10 * 0.1 AS lon, 45.0 + s_nationkey % 20 AS lat FROM supplier)"


def _lonlat(spark, d):
    return T(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (20.0 + 6 * F.col("s_nationkey") + F.col("s_suppkey") % 10 * 0.1).alias("lon"), (45.0 + F.col("s_nationkey") % 20).cast("double").alias("lat"))


@query("haversine", _LL + ", hv AS (SELECT k, pow(sin(radians(lat - 50) / 2), 2) + cos(radians(50)) * cos(radians(lat)) * pow(sin(radians(lon - 60) / 2), 2) AS h FROM ll)", "SELECT k, 6371.0088 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM hv", "km")
def haversine(spark, d):
    """Great-circle distance of each unit to a fixed point."""
    return _lonlat(spark, d).select("k", C.haversine_km(F.lit(60.0), F.lit(50.0), F.col("lon"), F.col("lat")).alias("km"))


@query("equal_area_blocks", _LL + """, c AS (SELECT sqrt(0.00669437999014) AS e, cos(radians(30)) / sqrt(1 - 0.00669437999014 * sin(radians(30)) ** 2) AS k0), xy AS (SELECT k, radians(lon) * 6378137.0 * k0 AS x, (1 - e * e) * (sin(radians(lat)) / (1 - e * e * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) * 6378137.0 / (2 * k0) AS y FROM ll, c)""",
       "SELECT k, CAST(floor(x / 200000 + 0.5) AS BIGINT) || ':' || CAST(floor(y / 200000) AS BIGINT) AS block FROM xy")
def equal_area_blocks(spark, d):
    return _lonlat(spark, d).select("k", C.block_id(F.col("lon"), F.col("lat"), 200.0, 0.5).alias("block"))


@query("ratio_direction", SUPPLIER_CTE, "SELECT unit, CASE WHEN wage / m > 1.02 THEN 'above' WHEN wage / m < 0.98 THEN 'below' ELSE 'near' END AS direction FROM sup, (SELECT median(wage) AS m FROM sup)")
def ratio_direction(spark, d):
    s = B.suppliers(spark, d)
    return s.crossJoin(F.broadcast(s.agg(F.median("wage").alias("m")))).select("unit", C.ratio_direction(F.col("wage"), F.col("m")).alias("direction"))


@query("relative_difference", SUPPLIER_CTE, "SELECT unit, abs(population - wage) / ((abs(population) + abs(wage)) / 2) AS difference FROM sup", "difference")
def relative_difference(spark, d):
    return B.suppliers(spark, d).select("unit", C.relative_difference(F.col("population"), F.col("wage")).alias("difference"))
