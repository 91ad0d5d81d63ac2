"""Internal validity indices of labelled points and graphs.

points: (g, i, vec, label); edges: graph edge tables. Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import settle, stash
from ..functions.columns import euclid
from .graphs import block_matrix, both_ways
from .pairs import own_and_nearest_group


def silhouettes(points: DataFrame) -> DataFrame:
    """(g, i, label, a, b, s): mean distance to the own class and to the nearest other; 0 for a single member."""
    both = own_and_nearest_group(points, "label", group="g", key="i", vec="vec")
    return both.selectExpr("g", "i", "label", "a", "b", "case when a is null then 0.0 when greatest(a, b) = 0 then 0.0 else (b - a) / greatest(a, b) end as s")


def silhouette(points: DataFrame) -> DataFrame:
    return silhouettes(points).groupBy("g").agg(F.avg("s").alias("silhouette"))


def _long(points: DataFrame) -> DataFrame:
    return points.select("g", "i", "label", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """(B / (K - 1)) / (W / (N - K)); null unless 2 <= K < N."""
    x = _long(points)
    cells = x.groupBy("g", "label", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = x.groupBy("g", "dim").agg(F.avg("x").alias("mm"))
    both = cells.join(whole, ["g", "dim"]).groupBy("g").agg(F.sum(F.expr("n * (m - mm) * (m - mm)")).alias("between"), F.sum(F.expr("n * v")).alias("within"))
    size = points.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"))
    return both.join(size, "g").selectExpr("g", "case when k >= 2 and k < n and within > 0 then (between / (k - 1)) / (within / (n - k)) end as calinski_harabasz")


def _centres(points: DataFrame, spread: str) -> DataFrame:
    """(g, label, centre, sd): centre vectors and the norm of the deviation (or variance) vector of each class."""
    cells = _long(points).groupBy("g", "label", "dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    term = "v" if spread == "sd" else "v * v"
    vec = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda r: r["m"])
    return cells.groupBy("g", "label").agg(vec.alias("centre"), F.sqrt(F.sum(F.expr(term))).alias("sd"))


def s_dbw(points: DataFrame, *, spread: str = "sd", radius: str = "mean", inside: bool = True, zero: str = "zero_for_zero") -> DataFrame:
    """S_Dbw = scatter + density between clusters, with the density parts.

    ``spread``: norms of deviation (sd) or variance vectors; ``radius``: mean of
    those norms (``mean``), or the root of their sum over K (``root``); ``inside``: count points within
    the closed ball, else outside; ``zero``: 0/0 counts as 0 and x/0 is undefined
    (``zero_for_zero``), or any zero denominator is undefined (``undefined``), or counts as 1 (``floor``).
    A midpoint counts members of its two clusters, a centre those of its own.
    Undefined for K < 2 or no dispersion.
    """
    centres = stash(_centres(points, spread))
    whole = _long(points).groupBy("g", "dim").agg(F.var_pop("x").alias("v")).groupBy("g").agg(F.sqrt(F.sum(F.expr("v" if spread == "sd" else "v * v"))).alias("sd_all"))
    k = centres.groupBy("g").agg(F.count("*").alias("k"), F.avg("sd").alias("sd_mean"), F.sqrt(F.sum("sd")).alias("root"))
    base = k.join(whole, "g").selectExpr("g", "k", "sd_mean / nullif(sd_all, 0.0) as scatter", "sd_mean as r" if radius == "mean" else "root / k as r")
    a, b = centres.selectExpr("g", "label as la", "centre as ca"), centres.selectExpr("g", "label as lb", "centre as cb")
    pairs = a.join(b, "g").where("la < lb").select("g", "la", "lb", F.zip_with("ca", "cb", lambda x, y: (x + y) / 2).alias("mid"))
    hit = lambda c: F.count_if((euclid(F.col("vec"), F.col(c)) <= F.col("r")) if inside else (euclid(F.col("vec"), F.col(c)) > F.col("r")))
    members, r = points.select("g", "label", "vec"), base.select("g", "r")
    # each class pair meets the members of its two classes only, each class's centre its members once
    meets = pairs.select("g", "la", "lb", F.explode(F.array("la", "lb")).alias("label"), "mid").join(members, ["g", "label"]).join(r, "g")
    own = stash(centres.select("g", "label", "centre").join(members, ["g", "label"]).join(r, "g").groupBy("g", "label").agg(hit("centre").alias("d")))
    dens = meets.groupBy("g", "la", "lb").agg(hit("mid").alias("d_mid"))
    dens = dens.join(own.selectExpr("g", "label as la", "d as d_a"), ["g", "la"]).join(own.selectExpr("g", "label as lb", "d as d_b"), ["g", "lb"])
    top = "greatest(d_a, d_b)"
    rule = {"zero_for_zero": f"case when {top} > 0 then d_mid / {top} when d_mid = 0 then 0.0 end", "undefined": f"case when {top} > 0 then d_mid / {top} end", "floor": f"d_mid / greatest({top}, 1)"}[zero]
    dens = dens.withColumn("ratio", F.expr(rule))
    out = dens.groupBy("g").agg(F.avg("ratio").alias("mean"), F.count_if(F.col("ratio").isNull()).alias("undefined_pairs"), F.count_if(F.expr(f"{top} = 0 and d_mid = 0")).alias("zero_pairs"))
    return base.join(out, "g", "left").selectExpr("g", "k", "scatter", "case when undefined_pairs = 0 then mean end as density", "case when undefined_pairs = 0 and k >= 2 then scatter + mean end as s_dbw", "undefined_pairs", "zero_pairs")


def block_indices(blocks: DataFrame) -> DataFrame:
    """AVI, AVU, ANUI and TurboMQ of a block matrix (g, ci, cj, s)."""
    rows = blocks.groupBy("g", F.col("ci").alias("c")).agg(F.sum("s").alias("total"), F.coalesce(F.sum(F.expr("case when ci = cj then s end")), F.lit(0.0)).alias("own"))
    rows = rows.selectExpr("*", "total - own as ext")
    each = rows.groupBy("g").agg(F.count("*").alias("k"), F.avg(F.expr("case when total > 0 then own / total else 0.0 end")).alias("avi"), F.sum(F.expr("case when own > 0 then (own / 2) / (own / 2 + ext / 2) else 0.0 end")).alias("turbo_mq"))
    ext = rows.select("g", "c", "ext")
    cross = blocks.where("ci <> cj").join(ext.select("g", F.col("c").alias("ci"), F.col("ext").alias("ei")), ["g", "ci"]).join(ext.select("g", F.col("c").alias("cj"), F.col("ext").alias("ej")), ["g", "cj"])
    avu = cross.groupBy("g").agg(F.sum(F.expr("case when ei + ej - s > 0 then s / (ei + ej - s) else 0.0 end")).alias("u"))
    out = each.join(avu, "g", "left").selectExpr("g", "k", "avi", "coalesce(u, 0.0) / k as avu", "turbo_mq")
    return out.selectExpr("*", "case when avi > 0 and avu + 1 / avi > 0 then 1 / (avu + 1 / avi) else 0.0 end as anui")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Weighted Newman-Girvan modularity: sum over classes of L_c / m - resolution (k_c / 2m)^2."""
    two = both_ways(edges)
    a, b = labels.select("g", "i", F.col("label").alias("ci")), labels.select("g", F.col("i").alias("j"), F.col("label").alias("cj"))
    x = two.join(a, ["g", "i"]).join(b, ["g", "j"])
    c = x.groupBy("g", "ci").agg(F.sum("weight").alias("k"), F.sum(F.expr("case when ci = cj then weight else 0.0 end")).alias("inner_w"))
    c = c.selectExpr("*", "sum(k) over (partition by g) as two_m")
    return c.groupBy("g").agg(F.sum(F.expr(f"inner_w / two_m - {resolution} * (k / two_m) * (k / two_m)")).alias("modularity"))


def _compared(points: DataFrame) -> DataFrame:
    """(g): the groups that have a silhouette, a point with a distance to all of another class; found without distances."""
    finite = F.coalesce(F.forall("vec", lambda x: F.coalesce(F.abs(x) < 1e150, F.lit(False))), F.lit(False))
    classes = points.where("label is not null").groupBy("g", "label").agg(F.min(finite).alias("whole"), F.max(finite).alias("some"))
    return classes.groupBy("g").agg(F.count_if("whole").alias("whole"), F.count_if("some").alias("some")).where("whole >= 1 and some >= 2").select("g")


def evaluate(points: DataFrame, edges: DataFrame, with_silhouette: bool = True) -> DataFrame:
    """All indices of one partition in a row for each g, with a status: which are undefined.

    Without the silhouette, whose distances cost the most by far, rows and status stay the same. Points are written once,
    and the edges are gone through once: the modularity is that of the block matrix.
    """
    points = stash(points)
    blocks = stash(block_matrix(edges, points.select("g", "i", "label")))  # classes squared
    rows = blocks.groupBy("g", "ci").agg(F.sum("s").alias("k"), F.sum(F.expr("case when ci = cj then s else 0.0 end")).alias("w")).selectExpr("*", "sum(k) over (partition by g) as two_m")
    q = rows.groupBy("g").agg(F.sum(F.expr("w / two_m - (k / two_m) * (k / two_m)")).alias("modularity"))
    out = (silhouette(points) if with_silhouette else _compared(points)).join(calinski_harabasz(points), "g").join(s_dbw(points).select("g", "k", "s_dbw"), "g")
    out = out.join(block_indices(blocks).drop("k"), "g").join(q, "g")
    names = ["silhouette"] * with_silhouette + ["calinski_harabasz", "s_dbw", "avi", "avu", "anui", "turbo_mq", "modularity"]
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in names)), lambda x: x.isNotNull()), ",")
    return settle(out.select("g", "k", *names, F.when(missing == "", "ok").otherwise(F.concat(F.lit("partially_undefined:"), missing)).alias("status")), points, blocks)
