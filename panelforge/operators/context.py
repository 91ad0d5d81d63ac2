"""Context of units: nearest units of other classes, neighbour geography, spatial strata, display layouts, test batteries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import block_id, haversine_km
from .alignment import assignment
from .inference import kruskal, mann_whitney, ols_slope, poisson_bootstrap, spearman, stratified_null
from .pairs import block_pairs, distances, group_sums
from .windows import benjamini_hochberg, top_k


def nearest_other(points: DataFrame, label: str, *, group: str = "g", key: str = "i", vec: str = "vec") -> DataFrame:
    """(group, i, j, d): the nearest unit of another class within the group, ties by id; units without one have no row."""
    g, kind = dict(points.dtypes)[group], dict(points.dtypes)[key]

    def side(who, left, lx, right, rx, dist):
        d = np.where(np.array(lx)[:, None] == np.array(rx)[None, :], np.inf, dist)
        j = d.argmin(axis=1)
        best = d[np.arange(len(left)), j]
        ok = np.isfinite(best)
        return pd.DataFrame({"g": who, "i": left[ok], "j": right[j[ok]], "d": best[ok]})

    def fn(who, ia, a, ea, ib, b, eb, same):
        dist = distances(a, b)
        one = side(who, ia, ea, ib, eb, dist)
        return one if same else pd.concat([one, side(who, ib, eb, ia, ea, dist.T)])

    near = block_pairs(points, group, key, vec, fn, f"g {g}, i {kind}, j {kind}, d double", extra=label)
    return near.groupBy(F.col("g").alias(group), "i").agg(F.min(F.struct("d", "j")).alias("m")).select(group, "i", F.col("m.j").alias("j"), F.col("m.d").alias("d"))


def match_quality(pairs: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(i, j, difference, quality): largest relative difference of the matched units' columns, in fixed bands."""
    a = rows.select(F.col(key).alias("i"), *(F.col(c).cast("double").alias(f"a_{c}") for c in columns))
    b = rows.select(F.col(key).alias("j"), *(F.col(c).cast("double").alias(f"b_{c}") for c in columns))
    worst = F.greatest(F.lit(0.0), *(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) / F.nullif(F.abs(F.col(f"a_{c}")), F.lit(0.0)) for c in columns))
    band = F.when(F.col("difference") <= 0.1, "close").when(F.col("difference") <= 0.25, "fair").otherwise("loose")
    return pairs.join(a, "i").join(b, "j").select("i", "j", worst.alias("difference")).withColumn("quality", band)


def neighbour_geography(edges: DataFrame, places: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Each unit's k nearest graph neighbours with kilometres (g, i, j, km), and a summary for each g over the directed pairs."""
    two = edges.select("g", F.col("src").alias("i"), F.col("dst").alias("j"), "distance").union(edges.select("g", "dst", "src", "distance"))
    a, b = places.select(F.col("unit").alias("i"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), places.select(F.col("unit").alias("j"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    near = top_k(two, k, ["g", "i"], "distance, j").join(a, "i").join(b, "j")
    km = near.select("g", "i", "j", haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("km"))
    return km, km.groupBy("g").agg(F.count("*").alias("pairs"), F.median("km").alias("median_km"), F.avg((F.col("km") > 500).cast("double")).alias("far_share"))


def spatial_ratio(points: DataFrame, places: DataFrame, flag: str, size_km: float, shift: float = 0.0) -> DataFrame:
    """(size_km, shift, observed, expected, ratio): mean distance among flagged units against its exact expectation
    for samples with as many units in each spatial block. points: (i, vec, flag column); places: (unit, lon, lat)."""
    x = points.join(places.select(F.col("unit").alias("i"), block_id(F.col("lon"), F.col("lat"), size_km, shift, shift).alias("label")), "i").withColumn("g", F.lit(0))
    strata = x.groupBy("label").agg(F.count("*").alias("n"), F.count_if(flag).alias("m"))
    expected = stratified_null(group_sums(x, "label", group="g", key="i", vec="vec"), strata)
    own = x.where(F.col(flag)).withColumn("label", F.lit("all"))
    observed = group_sums(own, "label", group="g", key="i", vec="vec").select((F.col("s") / F.col("n")).alias("observed"))
    return observed.crossJoin(expected).select(F.lit(float(size_km)).alias("size_km"), F.lit(float(shift)).alias("shift"), "observed", "expected", (F.col("observed") / F.col("expected")).alias("ratio"))  # rows of one


def display_projection(shares: DataFrame, classes: list[int]) -> DataFrame:
    """shares (i, cls, share): share-weighted mean of class anchors on a circle, with a sunflower offset by rank in the best class."""
    n = len(classes)
    anchor = F.create_map(*(F.lit(v) for k, c in enumerate(sorted(classes)) for v in (c, 2 * math.pi * k / n)))
    a = F.element_at(anchor, F.col("cls").cast("int"))
    best = F.min_by("cls", F.struct(-F.round("share", 9), F.col("cls")))
    x = shares.groupBy("i").agg(F.sum(F.col("share") * F.cos(a)).alias("x0"), F.sum(F.col("share") * F.sin(a)).alias("y0"), best.alias("best"))
    x = x.selectExpr("*", "row_number() over (partition by best order by i) - 1 as k")
    turn, step = F.col("k") * (math.pi * (3 - math.sqrt(5))), F.sqrt(F.col("k").cast("double")) * 0.01
    return x.select("i", "best", (F.col("x0") + step * F.cos(turn)).alias("x"), (F.col("y0") + step * F.sin(turn)).alias("y"))


def kernel_grid(points: DataFrame, cell: float, width: float, cutoff: float, least: int) -> DataFrame:
    """points (x, y, v) to (cx, cy, support, value): Gaussian-weighted means at grid nodes within ``cutoff``, where enough points reach.

    Each point is sent to the nodes near it only, so nothing meets every point.
    """
    reach = math.ceil(cutoff / cell)
    span = lambda c: F.explode(F.sequence((F.floor(F.col(c) / cell) - reach).cast("int"), (F.floor(F.col(c) / cell) + reach + 1).cast("int")))
    near = points.select("x", "y", "v", span("x").alias("cx")).select("x", "y", "v", "cx", span("y").alias("cy"))
    near = near.withColumn("d2", F.pow(F.col("x") - F.col("cx") * cell, 2) + F.pow(F.col("y") - F.col("cy") * cell, 2)).where(F.col("d2") <= cutoff * cutoff)
    w = F.exp(-F.col("d2") / (2 * width * width))
    return near.groupBy("cx", "cy").agg(F.count("*").alias("support"), (F.sum(w * F.col("v")) / F.sum(w)).alias("value")).where(F.col("support") >= least)


def align_by_period(labels: DataFrame) -> DataFrame:
    """labels (t, i, truth, label) to (t, i, aligned): one-to-one labels of largest overlap within each period; surplus clusters take their modal truth."""
    def run(t: pd.DataFrame) -> pd.DataFrame:
        table = pd.crosstab(t.label, t.truth)
        gain = table.to_numpy(float)
        wide = np.pad(gain, ((0, 0), (0, max(0, gain.shape[0] - gain.shape[1]))))
        got = assignment(wide)
        to = {c: int(table.columns[got[k]]) if got[k] < gain.shape[1] else int(table.columns[int(gain[k].argmax())]) for k, c in enumerate(table.index)}
        return pd.DataFrame({"t": t.t, "i": t.i, "aligned": t.label.map(to)})

    kinds = dict(labels.dtypes)
    return labels.groupBy("t").applyInPandas(run, f"t {kinds['t']}, i {kinds['i']}, aligned bigint")


def merge_tests(rows: DataFrame, key: str, group: str, indicators: list[str]) -> tuple[DataFrame, DataFrame]:
    """Omnibus (indicator, n, k, h, epsilon2) and pairwise (indicator, a, b, u, delta) rank tests of several indicators at once."""
    long = rows.select(key, group, *(F.col(c).cast("double").alias(c) for c in indicators)).unpivot([key, group], indicators, "indicator", "value").where("value is not null")
    return kruskal(long, group, "value", ["indicator"]), mann_whitney(long, group, "value", ["indicator"])


def dispersion_bootstrap(df: DataFrame, key: str, group: str, value: str, reps: int, seed: int) -> DataFrame:
    """(rep, dispersion): sample deviation of the groups' means under Poisson row weights."""
    return poisson_bootstrap(df, key, value, [group], reps, seed).groupBy("rep").agg(F.stddev_samp("mean").alias("dispersion"))


def battery(df: DataFrame, tests: list[dict], key: str) -> DataFrame:
    """(test, statistic): a configured list of tests {name, kind, x, y | group}: spearman, slope, cliff, median."""
    out = None
    for t in tests:
        if t["kind"] == "spearman":
            one = spearman(df, t["x"], t["y"], []).select(F.col("rho").alias("statistic"))
        elif t["kind"] == "slope":
            one = ols_slope(df.withColumn("_one", F.lit(1)), "_one", t["x"], t["y"]).select(F.col("slope").alias("statistic"))
        elif t["kind"] == "cliff":
            one = mann_whitney(df, t["group"], t["y"]).where((F.col("a") == t["a"]) & (F.col("b") == t["b"])).select(F.col("delta").alias("statistic"))
        elif t["kind"] == "median":
            one = df.agg(F.median(t["y"]).alias("statistic"))
        else:
            raise ValueError(f"unknown test {t['kind']}")
        one = one.select(F.lit(t["name"]).alias("test"), "statistic")
        out = one if out is None else out.unionByName(one)
    return out


def adjusted(df: DataFrame, p: str, family: str, key: str) -> DataFrame:
    return benjamini_hochberg(df, p, [family], key)


def public_text_problems(df: DataFrame, key: str, text: str, required: list[str], banned: list[str]) -> DataFrame:
    """(key, problem): rows whose text misses a required field mark or holds a banned token, case-insensitively."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    checks = [F.when(~low.contains(r.lower()), F.lit(f"missing {r}")) for r in required] + [F.when(low.contains(b.lower()), F.lit(f"banned {b}")) for b in banned]
    return df.select(key, F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))
