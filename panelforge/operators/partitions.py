"""Partition comparison from one contingency table (g, ref, cand, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import wilson


def contingency(labels: DataFrame) -> DataFrame:
    """labels (g, ref, cand) to (g, ref, cand, n)."""
    return labels.groupBy("g", "ref", "cand").agg(F.count("*").alias("n"))


def _margins(cont: DataFrame) -> DataFrame:
    return cont.selectExpr("*", "sum(n) over (partition by g, ref) as nr", "sum(n) over (partition by g, cand) as nc", "sum(n) over (partition by g) as total")


def _sums(cont: DataFrame) -> DataFrame:
    """Pair counts and entropies of cells and margins, one row for each g."""
    cells = cont.groupBy("g").agg(F.sum("n").alias("total"), F.sum(F.expr("n * (n - 1) / 2")).alias("p_both"), F.sum(F.expr("n * ln(n)")).alias("l_both"))
    for side, key in (("ref", "r"), ("cand", "c")):
        margin = cont.groupBy("g", side).agg(F.sum("n").alias("n")).groupBy("g").agg(F.count("*").alias(f"k_{key}"), F.sum(F.expr("n * (n - 1) / 2")).alias(f"p_{key}"), F.sum(F.expr("n * ln(n)")).alias(f"l_{key}"))
        cells = cells.join(margin, "g")
    # entropies in nats: H = ln T - sum n ln n / T
    return cells.selectExpr("*", "ln(total) - l_r / total as h_r", "ln(total) - l_c / total as h_c", "ln(total) - l_both / total as h_both", "total * (total - 1) / 2 as p_all")


def similarity(cont: DataFrame) -> DataFrame:
    """(g, ari, nmi): adjusted Rand index, and mutual information over the mean entropy; trivial equal partitions give 1."""
    s = _sums(cont)
    ari = F.expr("case when (p_r + p_c) / 2 = p_r * p_c / p_all or p_all = 0 then 1.0 else (p_both - p_r * p_c / p_all) / ((p_r + p_c) / 2 - p_r * p_c / p_all) end")
    nmi = F.expr("case when h_r + h_c <= 1e-15 then 1.0 else greatest(0.0, 2 * (h_r + h_c - h_both) / (h_r + h_c)) end")
    return s.select("g", ari.alias("ari"), nmi.alias("nmi"))


def crosswalk(cont: DataFrame) -> DataFrame:
    """For each reference class: size, dominant and second destination, retention, entropy (bits), destinations. Ties: the smaller label."""
    ranked = _margins(cont).selectExpr("*", "row_number() over (partition by g, ref order by n desc, cand) as place")
    return ranked.groupBy("g", "ref").agg(
        F.max("nr").alias("size"), F.max(F.expr("case when place = 1 then cand end")).alias("dominant"), F.max(F.expr("case when place = 2 then cand end")).alias("second"),
        F.max(F.expr("case when place = 1 then n / nr end")).alias("retention"), F.greatest(F.lit(0.0), F.sum(F.expr("-(n / nr) * log2(n / nr)"))).alias("entropy_bits"), F.count("*").alias("destinations"))


def crosswalk_long(cont: DataFrame) -> DataFrame:
    """Contingency with the share of the reference class, joined to the crosswalk."""
    return _margins(cont).selectExpr("g", "ref", "cand", "n", "n / nr as share").join(crosswalk(cont).select("g", "ref", "dominant", "retention"), ["g", "ref"])


def nestedness(cont: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.8, 0.95)) -> DataFrame:
    """Micro and macro purity, least retention, share of classes at or over each threshold."""
    c = crosswalk(cont)
    over = [F.avg((F.col("retention") >= t).cast("double")).alias(f"share_{int(t * 100)}") for t in thresholds]
    return c.groupBy("g").agg((F.sum(F.col("retention") * F.col("size")) / F.sum("size")).alias("micro_purity"), F.avg("retention").alias("macro_purity"), F.min("retention").alias("least_retention"), *over)


def pair_agreement(cont: DataFrame) -> DataFrame:
    """Pair retention and precision; null where there are no pairs."""
    return _sums(cont).selectExpr("g", "cast(p_both as bigint) as both_pairs", "case when p_r > 0 then p_both / p_r end as retention", "case when p_c > 0 then p_both / p_c end as precision")


def information(cont: DataFrame) -> DataFrame:
    """Entropies, conditional entropies, variation of information and its share of log2 N, in bits."""
    return _sums(cont).selectExpr("g", "h_r / ln(2) as h_ref", "h_c / ln(2) as h_cand", "greatest(0.0, h_both - h_r) / ln(2) as h_cand_given_ref", "greatest(0.0, h_both - h_c) / ln(2) as h_ref_given_cand",
                                  "greatest(0.0, 2 * h_both - h_r - h_c) / ln(2) as vi", "case when total > 1 then greatest(0.0, 2 * h_both - h_r - h_c) / ln(total) end as vi_share")


def structural_metrics(cont: DataFrame) -> DataFrame:
    out = similarity(cont)
    for other in (nestedness(cont), pair_agreement(cont), information(cont)):
        out = out.join(other, "g")
    return out


def profile_diagnostics(cont: DataFrame) -> DataFrame:
    """Retention, precision and Jaccard of each reference class with its dominant destination; share of its pairs kept together (1 for a single member)."""
    m = _margins(cont).selectExpr("*", "row_number() over (partition by g, ref order by n desc, cand) as place", "sum(n * (n - 1)) over (partition by g, ref) as inner_pairs")
    return m.where("place = 1").selectExpr("g", "ref", "cand as dominant", "nr as size", "n / nr as retention", "n / nc as precision", "n / (nr + nc - n) as jaccard", "case when nr = 1 then 1.0 else inner_pairs / (nr * (nr - 1)) end as within_pairs")


def cross_coassignment(cont: DataFrame) -> DataFrame:
    """(g, a, b, together): share of pairs of two reference classes (a < b) that the candidate puts together; none is 0."""
    m = _margins(cont).selectExpr("g", "ref", "cand", "n", "nr")
    a, b = m.selectExpr("g", "cand", "ref as a", "n as na", "nr as ra"), m.selectExpr("g", "cand", "ref as b", "n as nb", "nr as rb")
    met = a.join(b, ["g", "cand"]).where("a < b").groupBy("g", "a", "b").agg(F.sum(F.expr("na * nb / (ra * rb)")).alias("together"))
    refs = cont.select("g", "ref").distinct()
    grid = refs.withColumnRenamed("ref", "a").join(refs.withColumnRenamed("ref", "b"), "g").where("a < b")
    return grid.join(met, ["g", "a", "b"], "left").select("g", "a", "b", F.coalesce("together", F.lit(0.0)).alias("together"))


def state_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys.., changed boolean): n, changed, share and Wilson interval for each state."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))
    lo, hi = wilson(F.col("changed").cast("double"), F.col("n").cast("double"))
    return out.select(*keys, "n", "changed", (F.col("changed") / F.col("n")).alias("share"), lo.alias("low"), hi.alias("high"))


def canonical_relabel(labels: DataFrame, key: str = "g", label: str = "label") -> DataFrame:
    """(g, label, new): labels renumbered from 1 by size descending, then label."""
    sizes = labels.groupBy(key, label).agg(F.count("*").alias("n"))
    return sizes.selectExpr(key, label, f"row_number() over (partition by {key} order by n desc, {label}) as new", "n")


def canonical_by_last(labels: DataFrame) -> DataFrame:
    """labels (t, i, label): renumbered by size in the last period, labels absent there last by overall size."""
    last = labels.agg(F.max("t").alias("last"))
    sizes = labels.crossJoin(F.broadcast(last)).groupBy("label").agg(F.count_if(F.col("t") == F.col("last")).alias("n_last"), F.count("*").alias("n"))
    return sizes.selectExpr("label", "n_last", "n", "row_number() over (order by case when n_last > 0 then 0 else 1 end, n_last desc, n desc, label) as new")


def dominant_label(labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Modal label of each key, ties to the smallest, with its share."""
    n = labels.groupBy(*keys, label).agg(F.count("*").alias("n"))
    by = ", ".join(keys)
    return n.selectExpr("*", f"row_number() over (partition by {by} order by n desc, {label}) as place", f"n / sum(n) over (partition by {by}) as share").where("place = 1").select(*keys, F.col(label).alias("modal"), "n", "share")


def temporal_diagnostics(labels: DataFrame) -> DataFrame:
    """labels (t, i, label): for each t the similarity to t - 1 and the share of units with the same label."""
    moved = labels.selectExpr("t as g", "label as cand", "lag(label) over (partition by i order by t) as ref", "lag(t) over (partition by i order by t) as before").where("before = g - 1")
    same = moved.groupBy("g").agg(F.avg((F.col("ref") == F.col("cand")).cast("double")).alias("same_share"))
    return similarity(contingency(moved.select("g", "ref", "cand"))).join(same, "g").withColumnRenamed("g", "t")


def switches(labels: DataFrame) -> DataFrame:
    """(i, switches): label changes of each unit along t."""
    return labels.selectExpr("i", "case when label <> lag(label) over (partition by i order by t) then 1 else 0 end as s").groupBy("i").agg(F.sum("s").alias("switches"))


def flows(labels: DataFrame) -> DataFrame:
    """(t, src, dst, n): units moving between labels from t to their next period."""
    return labels.selectExpr("t", "label as src", "lead(label) over (partition by i order by t) as dst").where("dst is not null").groupBy("t", "src", "dst").agg(F.count("*").alias("n"))


def individual_stability(runs: DataFrame, reference: DataFrame) -> DataFrame:
    """runs (run, i, label) against reference (i, ref): for each unit, means over the runs of the share of its class mates
    that are with it (itself left out), and of precision and Jaccard of its class with its cluster."""
    x = runs.join(reference, "i")
    cell = x.groupBy("run", "label", "ref").agg(F.count("*").alias("n"))
    cell = cell.selectExpr("*", "sum(n) over (partition by run, label) as nc", "sum(n) over (partition by run, ref) as nr")
    y = x.join(cell, ["run", "label", "ref"])
    peer = F.expr("case when nr > 1 then (n - 1) / (nr - 1) else 1.0 end")
    return y.groupBy("i", "ref").agg(F.avg(peer).alias("peer"), F.avg(F.expr("n / nc")).alias("precision"), F.avg(F.expr("n / (nr + nc - n)")).alias("jaccard"))


def run_agreement(runs: DataFrame) -> DataFrame:
    """(a, b, ari, nmi) of all pairs of runs (a < b)."""
    x, y = runs.select(F.col("run").alias("a"), "i", F.col("label").alias("ref")), runs.select(F.col("run").alias("b"), "i", F.col("label").alias("cand"))
    pairs = x.join(y, "i").where("a < b").select(F.struct("a", "b").alias("g"), "ref", "cand")
    return similarity(contingency(pairs)).select("g.a", "g.b", "ari", "nmi")
