"""Synthetic temporal benchmark: planted panels, event scoring, trade-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import release, stash
from ..functions.columns import hash_normal, min_max
from .communities import detect
from .graphs import knn_graph
from .pairs import knn
from .partitions import contingency, similarity
from .windows import pareto_front

SCENARIOS = ("stable", "abrupt", "gradual", "boundary", "shock", "mixed")


def truth(spark: SparkSession, scenario: str, units: int, periods: int, classes: int = 3) -> DataFrame:
    """(t, i, label, role): class of each unit over time, planted from its number.

    A fifth of the units move to the next class at mid-time (abrupt, mixed), one by one
    over the middle third (gradual), or sit between classes all the time (boundary); in a
    shock all units are disturbed for one period and no class changes.
    """
    x = spark.range(units).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(periods - 1))).alias("t"))
    base = F.col("i") % classes
    moves = (F.col("i") % 5 == 0) if scenario in ("abrupt", "gradual", "mixed") else F.lit(False)
    at = F.lit(periods // 2)
    if scenario == "gradual":
        third = max(1, periods // 3)
        at = (F.lit(periods // 3) + F.floor(F.col("i") / 5) % third).cast("int")
    label = F.when(moves & (F.col("t") >= at), (base + 1) % classes).otherwise(base)
    role = F.when(moves, "mover").when(F.lit(scenario in ("boundary", "mixed")) & (F.col("i") % 7 == 0), "boundary").otherwise("core")
    return x.select("t", "i", label.cast("bigint").alias("label"), role.alias("role"))


def panel(spark: SparkSession, scenario: str, units: int, periods: int, seed: int, classes: int = 3, noise: float = 0.15) -> DataFrame:
    """(t, i, label, role, vec): points around class centres; draws are hashes of (seed, t, i, dimension)."""
    x = truth(spark, scenario, units, periods, classes)
    shock = F.when(F.lit(scenario in ("shock", "mixed")) & (F.col("t") == periods // 2), 3.0).otherwise(1.0)
    half = F.when(F.col("role") == "boundary", 0.5).otherwise(0.0)
    dims = [
        F.when(F.col("label") == k, 1.0 - half).when((F.col("label") + 1) % classes == k, half).otherwise(0.0) + noise * shock * hash_normal(seed, F.col("t"), F.col("i"), k)
        for k in range(classes)
    ]
    return x.withColumn("vec", F.array(*dims))


def monthly_metrics(labels: DataFrame) -> DataFrame:
    """labels (t, i, truth, label): similarity for each period; invariant to renaming labels within a period."""
    return similarity(contingency(labels.select(F.col("t").alias("g"), F.col("truth").alias("ref"), F.col("label").alias("cand")))).withColumnRenamed("g", "t")


def score_events(labels: DataFrame) -> DataFrame:
    """labels (t, i, truth, label): one row: true, inferred, hit events, precision, recall, f1, mean delay to the nearest
    inferred event of units with a true event, node accuracy. An event is a change from the period before."""
    x = labels.selectExpr("t", "i", "truth = label as same", "truth <> lag(truth) over (partition by i order by t) as a", "label <> lag(label) over (partition by i order by t) as b")
    c = x.agg(F.count_if("a").alias("true_events"), F.count_if("b").alias("inferred_events"), F.count_if(F.expr("a and b")).alias("hits"), F.avg(F.col("same").cast("double")).alias("accuracy"))
    a, b = x.where("a").select("i", F.col("t").alias("ta")), x.where("b").select("i", F.col("t").alias("tb"))
    delay = a.join(b, "i").groupBy("i", "ta").agg(F.min_by(F.col("tb") - F.col("ta"), F.struct(F.abs(F.col("tb") - F.col("ta")), "tb")).alias("d")).agg(F.avg("d").alias("delay"))
    out = c.crossJoin(delay)  # two rows of one
    p, r = "hits / nullif(inferred_events, 0)", "hits / nullif(true_events, 0)"
    return out.selectExpr("true_events", "inferred_events", "hits", f"{p} as precision", f"{r} as recall", "case when true_events + inferred_events > 0 then 2.0d * hits / (true_events + inferred_events) end as f1", "delay", "accuracy")


def temporal_runs(spark: SparkSession, omegas: list[float], units: int, periods: int, seed: int, k: int = 8) -> DataFrame:
    """(scenario, omega, ari, false_rate): communities of each scenario's temporal graph at each weight of temporal edges.

    ari is the mean over periods against the planted classes; false_rate the share of a unit's steps
    without a planted change at which its community changes. All graphs are found at once.
    """
    whole = None
    for s in SCENARIOS:
        one = panel(spark, s, units, periods, seed).withColumn("scenario", F.lit(s))
        whole = one if whole is None else whole.unionByName(one)
    points = stash(whole.withColumn("g", F.concat_ws(":", "scenario", "t")))
    edges = stash(knn_graph(knn(points, k, group="g", key="i", vec="vec"), fallback=True))
    node = lambda t, i: (F.col(t) * units + F.col(i)).cast("bigint")
    layer = edges.withColumn("scenario", F.substring_index("g", ":", 1)).withColumn("t", F.substring_index("g", ":", -1).cast("int"))
    grid = F.explode(F.array(*(F.lit(float(w)) for w in omegas))).alias("omega")
    inner = layer.select("scenario", grid, node("t", "src").alias("src"), node("t", "dst").alias("dst"), "weight")
    middle = stash(layer.groupBy("scenario").agg(F.median("weight").alias("m")))
    steps = points.where(F.col("t") > 0).select("scenario", grid, node("t", "i").alias("dst")).join(middle, "scenario")
    across = steps.select("scenario", "omega", (F.col("dst") - units).alias("src"), "dst", (F.col("omega") * F.col("m")).alias("weight")).where("weight > 0")
    flat = stash(inner.unionByName(across).withColumn("g", F.concat_ws(":", "scenario", "omega")))
    found = detect(flat).select(F.substring_index("g", ":", 1).alias("scenario"), F.substring_index("g", ":", -1).cast("double").alias("omega"), F.pmod("i", F.lit(units)).alias("i"), F.floor(F.col("i") / units).cast("int").alias("t"), F.col("label").alias("cand"))
    both = stash(found.join(points.select("scenario", "t", "i", F.col("label").alias("ref")), ["scenario", "t", "i"]))
    release(flat, edges, points, middle)
    cells = contingency(both.select(F.struct("scenario", "omega", "t").alias("g"), "ref", "cand"))
    ari = similarity(cells).groupBy("g.scenario", "g.omega").agg(F.avg("ari").alias("ari"))
    moved = both.selectExpr("scenario", "omega", *(f"{c} <> lag({c}) over (partition by scenario, omega, i order by t) as {c}" for c in ("ref", "cand")))
    calm = moved.where("not ref").groupBy("scenario", "omega").agg(F.avg(F.col("cand").cast("double")).alias("false_rate"))
    return ari.join(calm, ["scenario", "omega"])


def tradeoff(results: DataFrame) -> DataFrame:
    """results (scenario, omega, ari, false_rate): min-max scores within scenarios, their means for each omega, Pareto flags."""
    x = results.select("scenario", "omega", min_max("ari", "scenario").alias("a"), min_max("false_rate", "scenario", higher=False).alias("b"))
    m = x.groupBy("omega").agg(F.avg("a").alias("fidelity"), F.avg("b").alias("calm"))
    return pareto_front(m, "omega", "fidelity", "calm")
