"""Similarity graphs as edge tables (g, src, dst, weight, distance, fallback) with src < dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import components, stash
from ..functions.columns import KERNEL_EPSILON, hash_normal, hash_uniform
from .pairs import knn, order_statistics, pairs_within

EDGE = ["g", "src", "dst", "weight", "distance", "fallback"]


def bandwidths(near: DataFrame, g: str = "g") -> DataFrame:
    """(g, i, sigma): distance to the k-th neighbour."""
    return near.groupBy(g, "i").agg(F.max("d").alias("sigma"))


def _weighted(pairs: DataFrame, sigma: DataFrame) -> DataFrame:
    """Adaptive Gaussian kernel exp(-d^2 / (sigma_i sigma_j + 1e-12))."""
    s1 = sigma.select("g", F.col("i").alias("src"), F.col("sigma").alias("s1"))
    s2 = sigma.select("g", F.col("i").alias("dst"), F.col("sigma").alias("s2"))
    w = F.exp(-F.col("distance") * F.col("distance") / (F.col("s1") * F.col("s2") + KERNEL_EPSILON))
    return pairs.join(s1, ["g", "src"]).join(s2, ["g", "dst"]).select("g", "src", "dst", w.alias("weight"), "distance", "fallback")


def _undirected(directed: DataFrame, fallback: bool) -> DataFrame:
    return directed.select("g", F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), F.col("d").alias("distance"), F.lit(fallback).alias("fallback"))


def knn_graph(near: DataFrame, *, mutual: bool = True, fallback: bool = False) -> DataFrame:
    """Mutual or union k-nearest-neighbour graph of a directed neighbour table (g, i, j, d, rank).

    With ``fallback``, a point without an edge is joined to its nearest neighbour. The table is
    written once: pairs and both ends' bandwidths read it.
    """
    near = stash(near)
    pairs = _undirected(near, False)
    n = pairs.groupBy("g", "src", "dst").agg(F.count("*").alias("n"), F.min("distance").alias("distance"))
    kept = n.where("n = 2" if mutual else "n >= 1").select("g", "src", "dst", "distance", F.lit(False).alias("fallback"))
    if fallback:
        touched = kept.select("g", F.explode(F.array("src", "dst")).alias("i")).distinct()
        alone = near.where("rank = 1").join(touched, ["g", "i"], "left_anti")
        kept = kept.union(_undirected(alone, True).distinct())
    return _weighted(kept, bandwidths(near))


def epsilon_graph(points: DataFrame, near: DataFrame, target: int, *, key: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Edges with distance <= the target-th smallest distance (ties included), and a calibration row for each group."""
    groups = points.select("g").distinct()
    eps = order_statistics(points, groups.withColumn("rank", F.lit(target)), group="g", key=key, vec=vec).select("g", F.col("distance").alias("eps"))
    found = pairs_within(points, eps, group="g", key=key, vec=vec)
    edges = _weighted(found.select("g", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("distance"), F.lit(False).alias("fallback")), bandwidths(near))
    touched = edges.select("g", F.explode(F.array("src", "dst")).alias("i")).groupBy("g").agg(F.count_distinct("i").alias("touched"))
    sizes = points.groupBy("g").agg(F.count("*").alias("n"))
    row = edges.groupBy("g").agg(F.count("*").alias("edges")).join(eps, "g").join(touched, "g").join(sizes, "g")
    return edges, row.select("g", F.lit(target).cast("bigint").alias("target"), "eps", "edges", (F.col("edges") - target).alias("excess"), (F.col("n") - F.col("touched")).alias("isolates"))


def dynamics_vectors(clr: DataFrame) -> DataFrame:
    """(unit, vec): changes of each part, centred and unit-normalised, over the root of the number of parts.

    The Euclidean distance of two such vectors is sqrt(2 (1 - s)) for the mean
    per-part Pearson correlation s of the changes; a constant change is an error.
    """
    change = clr.selectExpr("unit", "category", "t", "clr - lag(clr) over (partition by unit, category order by t) as d").where("d is not null")
    centred = change.selectExpr("unit", "category", "t", "d - avg(d) over (partition by unit, category) as e")
    scaled = centred.selectExpr("unit", "category", "t", "e", "sqrt(sum(e * e) over (partition by unit, category)) as size")
    unit = F.when(F.col("size") > 1e-12, F.col("e") / F.col("size")).otherwise(F.raise_error(F.lit("constant change")).cast("double"))
    rows = scaled.select("unit", F.struct("category", "t", unit.alias("x")).alias("row")).groupBy("unit").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    parts = F.size(F.array_distinct(F.transform("rows", lambda r: r["category"])))
    return rows.select("unit", F.transform("rows", lambda r: r["x"] / F.sqrt(parts.cast("double"))).alias("vec"))


def dynamics_graph(vectors: DataFrame, k: int) -> DataFrame:
    """Mutual graph of co-moving units with kernel weights and the similarity."""
    near = knn(vectors.withColumn("g", F.lit(0)), k, group="g", key="unit", vec="vec")
    return knn_graph(near).withColumn("similarity", 1 - F.col("distance") * F.col("distance") / 2)


def supra_graph(layers: DataFrame, units: DataFrame, omega: float) -> DataFrame:
    """(t, src, t2, dst, weight, kind): edges within periods and between one unit's consecutive periods.

    ``layers``: edge table with g = period; ``units``: (g, i) nodes of each period. Temporal
    edges weigh omega times the median weight over all periods. Layers are written once.
    """
    layers = stash(layers)
    inner = layers.select(F.col("g").alias("t"), "src", F.col("g").alias("t2"), "dst", "weight", F.lit("intra").alias("kind"))
    mid = layers.agg((F.median("weight") * omega).alias("weight"))
    steps = units.selectExpr("g as t", "i as src", "lead(g) over (partition by i order by g) as t2").where("t2 is not null")
    return inner.unionByName(steps.crossJoin(F.broadcast(mid)).select("t", "src", "t2", F.col("src").alias("dst"), "weight", F.lit("temporal").alias("kind")))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("g", F.col("src").alias("i"), F.col("dst").alias("j"), "weight").union(edges.select("g", F.col("dst"), F.col("src"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(g, i, degree, strength)."""
    return both_ways(edges).groupBy("g", "i").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def node_table(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, i, degree, strength, component) of all nodes (g, i); an isolate is its own component."""
    key = lambda a: F.struct(F.col("g").alias("g"), F.col(a).alias("i"))
    comp = components(edges.select(key("src").alias("a"), key("dst").alias("b")), few=200_000).select(F.col("node.g").alias("g"), F.col("node.i").alias("i"), F.col("comp.i").alias("component"))
    out = nodes.join(degrees(edges), ["g", "i"], "left").join(comp, ["g", "i"], "left")
    return out.select("g", "i", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("component", "i").alias("component"))


def graph_diagnostics(edges: DataFrame, table: DataFrame) -> DataFrame:
    """One row for each graph: nodes, edges, density, mean/max degree, components, isolates, weight, negative weights."""
    e = edges.groupBy("g").agg(F.count("*").alias("edges"), F.sum("weight").alias("total_weight"), F.count_if(F.col("weight") < 0).alias("negative"))
    n = table.groupBy("g").agg(F.count("*").alias("nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.count_distinct("component").alias("components"), F.count_if(F.col("degree") == 0).alias("isolates"))
    return n.join(e, "g", "left").select("g", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), (2 * F.coalesce("edges", F.lit(0)) / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"), "mean_degree", "max_degree", "components", "isolates", "total_weight", "negative")


def edge_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(g, common, either, jaccard) of two edge sets."""
    sides = a.select("g", "src", "dst", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("g", "src", "dst", F.lit(0), F.lit(1)))
    each = sides.groupBy("g", "src", "dst").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return each.groupBy("g").agg(F.sum(F.col("x") * F.col("y")).alias("common"), F.count("*").alias("either")).withColumn("jaccard", F.col("common") / F.col("either"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(g, src, dst, weight) with src < dst in order; a self-loop is an error."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    checked = F.when(a != b, a).otherwise(F.raise_error(F.lit("self-loop")).cast(dict(edges.dtypes)["src"]))
    return edges.select("g", checked.alias("src"), b.alias("dst"), "weight").orderBy("g", "src", "dst")


def perturb(supra: DataFrame, seed: int, drop: float = 0.05, sigma: float = 0.02) -> DataFrame:
    """Drop intralayer edges and jitter the others' weights log-normally; temporal edges are untouched.

    Draws are hashes of (seed, period, src, dst), so partitioning and row order don't matter.
    """
    key = (seed, F.col("t"), F.col("src"), F.col("dst"))
    inner = F.col("kind") == "intra"
    kept = supra.where(~inner | (hash_uniform(*key) >= drop))
    return kept.withColumn("weight", F.when(inner, F.col("weight") * F.exp(sigma * hash_normal(*key, 7))).otherwise(F.col("weight")))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (g, i)."""
    a, b = nodes.select("g", F.col("i").alias("src")), nodes.select("g", F.col("i").alias("dst"))
    return edges.join(a, ["g", "src"], "left_semi").join(b, ["g", "dst"], "left_semi")


def modularity_residual(edges: DataFrame) -> DataFrame:
    """Residual w - k_i k_j / 2m on the edges; off the edges it is the rank-one term alone, (-k_i k_j / 2m)."""
    deg = degrees(edges)
    total = deg.groupBy("g").agg(F.sum("strength").alias("two_m"))
    a, b = deg.select("g", F.col("i").alias("src"), F.col("strength").alias("ka")), deg.select("g", F.col("i").alias("dst"), F.col("strength").alias("kb"))
    return edges.join(a, ["g", "src"]).join(b, ["g", "dst"]).join(total, "g").select("g", "src", "dst", (F.col("weight") - F.col("ka") * F.col("kb") / F.col("two_m")).alias("residual"))


def block_matrix(edges: DataFrame, labels: DataFrame, weighted: bool = True) -> DataFrame:
    """(g, ci, cj, s): each edge adds to both (ci, cj) and (cj, ci), an inner edge twice to (c, c). labels: (g, i, label)."""
    two = both_ways(edges)
    a, b = labels.select("g", "i", F.col("label").alias("ci")), labels.select("g", F.col("i").alias("j"), F.col("label").alias("cj"))
    w = F.col("weight") if weighted else F.lit(1.0)
    return two.join(a, ["g", "i"]).join(b, ["g", "j"]).groupBy("g", "ci", "cj").agg(F.sum(w).alias("s"))
