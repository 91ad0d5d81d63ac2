"""Test statistics, regressions, exact nulls and hash-based resampling.

Statistics are aggregates; p-values of reference distributions come from
``tails``. Resampling draws are hashes of (seed, replicate, row), so any engine
and any partitioning repeats them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import stash
from ..functions.columns import hash_uniform
from .panel import numbered
from .windows import counted, ranks_of

# --- ranks -----------------------------------------------------------------------------
#
# All from counts of distinct values and their ranks; rows are never ranked one by one.


def _rank_sums(df: DataFrame, group: str, value: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, group, m, r): rows and rank sum of each group; (keys, n, ties): rows and sum of t^3 - t."""
    ranks = stash(ranks_of(counted(df, value, keys), value, keys))
    held = df.groupBy(*keys, group, value).agg(F.count("*").alias("_c")).join(ranks, [*keys, value])
    each = held.groupBy(*keys, group).agg(F.sum("_c").alias("m"), F.sum(F.col("_c") * F.col("_rank")).alias("r"))
    t = F.col("_t").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum("_t").alias("n"), F.sum(t * t * t - t).alias("ties"))
    return each, ties


def kruskal(df: DataFrame, group: str, value: str, keys: list[str], corrected: bool = True) -> DataFrame:
    """(keys, h, epsilon2, n, k): Kruskal-Wallis H, corrected for ties unless told not to, and max(0, (H - k + 1) / (n - k))."""
    each, ties = _rank_sums(df, group, value, keys)
    per = each.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(F.expr("r * r / m")).alias("s"))
    met = per.join(ties, keys) if keys else per.crossJoin(ties)  # rows of one
    shrink = "nullif(1 - coalesce(ties / nullif(cast(n as double) * n * n - n, 0.0d), 0.0d), 0.0d)" if corrected else "1"
    out = met.selectExpr(*keys, "n", "k", f"(12.0d / (n * (n + 1)) * s - 3 * (n + 1)) / {shrink} as h").where("n > 0")
    return out.selectExpr(*keys, "n", "k", "h", "case when n > k then greatest(0.0d, (h - k + 1) / (n - k)) end as epsilon2")


def mann_whitney(df: DataFrame, group: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, a, b, na, nb, u, delta): U of each pair of groups and Cliff's delta, from ranks in the pair (no pairs of rows)."""
    keys = keys or []
    held = stash(df.groupBy(*keys, F.col(group).alias("_g"), value).agg(F.count("*").alias("_c")))
    names = held.select(*keys, "_g").distinct()
    left, right = names.withColumnRenamed("_g", "a"), names.withColumnRenamed("_g", "b")
    pairs = (left.join(right, keys) if keys else left.crossJoin(right)).where("a < b")  # a row for each pair of groups
    sides = pairs.select(*keys, "a", "b", F.explode(F.array("a", "b")).alias("_g"))
    both = sides.join(held, [*keys, "_g"]).groupBy(*keys, "a", "b", value).agg(F.sum("_c").alias("_t"), F.sum(F.expr("if(_g = a, _c, 0)")).alias("_l"))
    ranked = ranks_of(both, value, [*keys, "a", "b"])
    out = ranked.groupBy(*keys, "a", "b").agg(F.sum("_l").alias("na"), F.sum(F.col("_t") - F.col("_l")).alias("nb"), F.sum(F.col("_l") * F.col("_rank")).alias("r"))
    return out.selectExpr(*keys, "a", "b", "na", "nb", "r - na * (na + 1) / 2.0d as u", "2 * (r - na * (na + 1) / 2.0d) / (na * nb) - 1 as delta")


def dunn(df: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, z): Dunn's pairwise z with tie correction."""
    each, ties = _rank_sums(df, group, value, [])
    each = stash(each)
    a, b = each.selectExpr(f"{group} as a", "m as ma", "r / m as ra"), each.selectExpr(f"{group} as b", "m as mb", "r / m as rb")
    pairs = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(ties))  # a row for each pair of groups
    return pairs.selectExpr("a", "b", "(ra - rb) / sqrt(n * (n + 1) / 12.0d * (1 - ties / cast(n * n * n - n as double)) * (1.0d / ma + 1.0d / mb)) as z")


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, n, rho) over rows that have both values; the mean rank is known, so sums are taken about it."""
    held = stash(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c")))
    side = lambda c, r: stash(ranks_of(held.groupBy(*keys, c).agg(F.sum("_c").alias("_t")), c, keys).select(*keys, c, (F.col("_rank") - (F.col("_n") + 1) / 2).alias(r)))
    met = held.join(side("_x", "_rx"), [*keys, "_x"]).join(side("_y", "_ry"), [*keys, "_y"])
    total = lambda a, b: F.sum(F.col("_c") * F.col(a) * F.col(b))
    rho = total("_rx", "_ry") / F.nullif(F.sqrt(total("_rx", "_rx") * total("_ry", "_ry")), F.lit(0.0))
    cols = [F.sum("_c").alias("n"), rho.alias("rho")]
    return met.groupBy(*keys).agg(*cols) if keys else met.agg(*cols)


def wilcoxon(df: DataFrame, diff: str, keys: list[str]) -> DataFrame:
    """(keys, n, w): signed-rank statistic min(R+, R-), zeros dropped."""
    held = df.where(F.col(diff) != 0).groupBy(*keys, F.abs(diff).alias("_a")).agg(F.count("*").alias("_t"), F.count_if(F.col(diff) > 0).alias("_up"))
    r = ranks_of(held, "_a", keys)
    out = r.groupBy(*keys).agg(F.sum("_t").alias("n"), F.sum(F.col("_up") * F.col("_rank")).alias("p"), F.sum((F.col("_t") - F.col("_up")) * F.col("_rank")).alias("m"))
    return out.select(*keys, "n", F.least("p", "m").alias("w"))


# --- slopes and dispersion -----------------------------------------------------------------


def theil_sen(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, slope): median of pair slopes over each short series."""
    series = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(value).alias("v")))).alias("s"))
    pairs = F.flatten(F.transform(F.col("s"), lambda a: F.transform(F.filter(F.col("s"), lambda b: b["t"] > a["t"]), lambda b: (b["v"] - a["v"]) / (b["t"] - a["t"]))))
    sorted_ = series.select(key, F.array_sort(pairs).alias("p")).withColumn("n", F.size("p"))
    at = lambda k: F.element_at("p", F.floor(k).cast("int"))
    return sorted_.where("n > 0").select(key, ((at((F.col("n") + 1) / 2) + at((F.col("n") + 2) / 2)) / 2).alias("slope"))


def ols_slope(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.regr_slope(F.col(value), F.col(t).cast("double")).alias("slope"))


def group_dispersion(df: DataFrame, period: str, group: str, value: str) -> DataFrame:
    """(period, dispersion): sample deviation of group means."""
    return df.groupBy(period, group).agg(F.avg(value).alias("m")).groupBy(period).agg(F.stddev_samp("m").alias("dispersion"))


# --- regression -------------------------------------------------------------------------------


def normal_equations(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and n as sums over the cluster; p x p numbers reach the driver."""
    cols = [F.sum(F.col(a) * F.col(b)).alias(f"m{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    r = df.agg(*cols, *(F.sum(F.col(a) * F.col(y)).alias(f"v{i}") for i, a in enumerate(xs)), F.count("*").alias("n")).first()
    p = len(xs)
    m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    return m, np.array([r[f"v{i}"] for i in range(p)], float), int(r.n)


def ols(df: DataFrame, xs: list[str], y: str) -> dict:
    """Least squares (pseudo-inverse of the normal equations): beta, rss, rank, n, inverse."""
    m, v, n = normal_equations(df, xs, y)
    inv = np.linalg.pinv(m, hermitian=True)
    beta = inv @ v
    # residuals are summed in a pass of their own: y'y - b'X'y would cancel
    left = F.col(y) - sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))
    rss = float(df.agg(F.sum(left * left)).first()[0] or 0.0)
    return {"beta": beta, "rss": rss, "rank": int(np.linalg.matrix_rank(m, hermitian=True)), "n": n, "inverse": inv}


def _hc3_covariance(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray]:
    """OLS coefficients and their HC3 covariance; leverages and the meat are computed over the cluster."""
    fit = ols(df, xs, y)
    p = len(xs)
    pred = sum((F.col(x) * float(b) for x, b in zip(xs, fit["beta"], strict=True)), F.lit(0.0))
    lev = sum((F.col(xs[i]) * F.col(xs[j]) * float(fit["inverse"][i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
    e = df.withColumn("_w", F.pow((F.col(y) - pred) / (1 - lev), 2))
    meat = e.agg(*(F.sum(F.col(xs[i]) * F.col(xs[j]) * F.col("_w")).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p))).first()
    mid = np.array([[meat[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    return fit["beta"], fit["inverse"] @ mid @ fit["inverse"]


def hc3(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(term, beta, se): OLS with HC3 errors."""
    beta, cov = _hc3_covariance(df, xs, y)
    rows = [(x, float(b), float(math.sqrt(max(0.0, cov[i, i])))) for i, (x, b) in enumerate(zip(xs, beta, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double")


def hc3_wald(df: DataFrame, xs: list[str], terms: list[str], y: str) -> DataFrame:
    """(wald, df): joint HC3 Wald statistic of some terms, and the rank of their covariance."""
    beta, cov = _hc3_covariance(df, xs, y)
    at = [xs.index(t) for t in terms]
    own = cov[np.ix_(at, at)]
    wald = float(beta[at] @ np.linalg.pinv(own, hermitian=True) @ beta[at])
    return df.sparkSession.createDataFrame([(wald, int(np.linalg.matrix_rank(own, hermitian=True)))], "wald double, df int")


def partial_r2(df: DataFrame, reduced: list[str], added: list[str], y: str) -> DataFrame:
    """(rss_reduced, rss_full, f, partial_r2): incremental F and partial R2 in [0, 1]."""
    a, b = ols(df, reduced, y), ols(df, [*reduced, *added], y)
    q, dof = b["rank"] - a["rank"], b["n"] - b["rank"]
    gain = max(0.0, a["rss"] - b["rss"])
    f = (gain / q) / (b["rss"] / dof) if q > 0 and dof > 0 and b["rss"] > 0 else None
    r2 = min(1.0, max(0.0, gain / a["rss"])) if a["rss"] > 0 else 0.0
    return df.sparkSession.createDataFrame([(a["rss"], b["rss"], f, r2)], "rss_reduced double, rss_full double, f double, partial_r2 double")


def fixed_effect_beta(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(beta, n): slope with a fixed effect of each group, by demeaning within groups."""
    d = df.selectExpr(f"{x} - avg({x}) over (partition by {group}) as dx", f"{y} - avg({y}) over (partition by {group}) as dy")
    return d.agg((F.sum(F.col("dx") * F.col("dy")) / F.sum(F.col("dx") * F.col("dx"))).alias("beta"), F.count("*").alias("n"))


# --- adjusted tests: fixed effects absorbed, residuals permuted within strata ----------------------------


def moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, int]:
    """Cross moments of columns and the number of rows, in one pass; a matrix of their size reaches the driver."""
    k = len(cols)
    r = df.agg(*(F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)), F.count("*").alias("n")).first()
    return np.array([[r[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], float), int(r.n)


def permuted(df: DataFrame, key: str, strata: list[str], values: list[str], keep: list[str], reps: int, seed: int) -> DataFrame:
    """(rep, key, keep, values): in each replicate the values of a stratum's rows are dealt out anew to its rows.

    The order is by hash of (seed, replicate, key), so any engine repeats it; ``keep`` stays where it was.
    """
    by = ", ".join(["rep", *strata])
    x = replicates(df.select(key, *strata, *values), reps).withColumn("_u", hash_uniform(seed, F.col("rep"), F.col(key)))
    x = x.selectExpr("rep", *strata, *values, f"row_number() over (partition by {by} order by _u, {key}) as _pos")
    if strata:
        fixed = df.selectExpr(key, *strata, *keep, f"row_number() over (partition by {', '.join(strata)} order by {key}) as _pos")
    else:
        fixed = numbered(df, key).select(key, (F.col("idx") + 1).alias("_pos")).join(df.select(key, *keep), key)
    return x.join(fixed, [*strata, "_pos"]).select("rep", key, *keep, *values)


def reduced_residuals(df: DataFrame, key: str, stratum: str, ys: list[str], covariates: list[str], added: list[str], keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Residuals e0, e1, ... of outcomes and z0, z1, ... of added terms on covariates and a fixed effect of each stratum.

    Fixed effects are absorbed by centring within strata, so their number doesn't matter; rows with a null are left out.
    """
    cols = [*ys, *covariates, *added]
    whole = df.select(key, stratum, *(keep or []), *cols).dropna(subset=[stratum, *cols])
    mid = whole.selectExpr(key, stratum, *(keep or []), *(f"{c} - avg({c}) over (partition by {stratum}) as {c}" for c in cols))
    mid = stash(mid)
    m, n = moments(mid, cols)
    ny, nx = len(ys), len(covariates)
    xx = m[ny:ny + nx, ny:ny + nx]
    inv = np.linalg.pinv(xx, hermitian=True) if nx else np.zeros((0, 0))
    left = lambda c, k: F.col(c) - sum((F.col(x) * float(w) for x, w in zip(covariates, inv @ m[ny:ny + nx, k], strict=True)), F.lit(0.0))
    out = mid.select(key, stratum, *(keep or []), *covariates, *(left(c, k).alias(f"e{k}") for k, c in enumerate(ys)), *(left(c, ny + nx + k).alias(f"z{k}") for k, c in enumerate(added)))
    strata = mid.agg(F.count_distinct(stratum)).first()[0]
    return stash(out), {"n": n, "strata": int(strata), "rank": int(strata) + (int(np.linalg.matrix_rank(xx, hermitian=True)) if nx else 0), "inverse": inv}


def freedman_lane(df: DataFrame, key: str, stratum: str, ys: list[str], covariates: list[str], added: list[str], reps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Test of added terms given covariates and a fixed effect of each stratum; several outcomes are one multivariate test (trace).

    Returns one row (n, strata, q, dof, sse_reduced, sse_full, partial_r2, f, reps, exceed, p) and the draws (rep, partial_r2, f):
    residuals of the reduced model are permuted within strata. A replicate is a handful of sums, since what is added is
    orthogonal to the reduced model.
    """
    r, fit = reduced_residuals(df, key, stratum, ys, covariates, added)
    es, zs = [f"e{k}" for k in range(len(ys))], [f"z{k}" for k in range(len(added))]
    m, n = moments(r, [*es, *zs])
    ny = len(ys)
    zz, ze = m[ny:, ny:], m[ny:, :ny]
    zinv, q = np.linalg.pinv(zz, hermitian=True), int(np.linalg.matrix_rank(zz, hermitian=True))
    sse, gain = float(np.trace(m[:ny, :ny])), float(np.trace(ze.T @ zinv @ ze))
    dof = n - fit["rank"] - q
    stat = lambda g, s: (g / q) / ((s - g) / dof) if q > 0 and dof > 0 and s > g else None
    observed = stat(gain, sse)

    x = permuted(r, key, [stratum], es, [*covariates, *zs], reps, seed)
    sums = [F.sum(F.col(a) * F.col(e)).alias(f"{a}_{e}") for a in [*covariates, *zs] for e in es]
    form = lambda names, w, e: sum((F.col(f"{a}_{e}") * F.col(f"{b}_{e}") * float(w[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)), F.lit(0.0))
    draws = x.groupBy("rep").agg(*sums).select("rep", sum((form(zs, zinv, e) for e in es), F.lit(0.0)).alias("g"), (F.lit(sse) - sum((form(covariates, fit["inverse"], e) for e in es), F.lit(0.0))).alias("s"))
    draws = stash(draws.select("rep", (F.col("g") / F.col("s")).alias("partial_r2"), ((F.col("g") / F.lit(float(q or 1))) / F.nullif((F.col("s") - F.col("g")) / F.lit(float(dof) if dof > 0 else None), F.lit(0.0))).alias("f")))
    exceed = draws.where(F.col("f") >= F.lit(observed) * (1 - 1e-9)).count() if observed is not None else None
    row = (n, fit["strata"], q, dof, sse, sse - gain, min(1.0, max(0.0, gain / sse)) if sse > 0 else 0.0, observed, reps, exceed, (1 + exceed) / (reps + 1) if exceed is not None else None)
    form = "n bigint, strata bigint, q bigint, dof bigint, sse_reduced double, sse_full double, partial_r2 double, f double, reps bigint, exceed bigint, p double"
    return df.sparkSession.createDataFrame([row], form), draws


def null_summary(draws: DataFrame, value: str) -> DataFrame:
    """(minimum, q05, median, q95, maximum, mean, sd) of a null distribution."""
    q = lambda p: F.percentile(value, p)
    return draws.agg(F.min(value).alias("minimum"), q(0.05).alias("q05"), q(0.5).alias("median"), q(0.95).alias("q95"), F.max(value).alias("maximum"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def _pseudo_f(rows: DataFrame, label: str, cols: list[str], keys: list[str]) -> DataFrame:
    """(keys, f, r2) of centred columns: squared group sums over sizes are the variation between groups."""
    each = rows.groupBy(*keys, label).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in cols), F.sum(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))).alias("t"))
    between = F.sum(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)) / F.col("n"))
    per = each.groupBy(*keys).agg(between.alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return per.selectExpr(*keys, "(b / (k - 1)) / ((t - b) / (n - k)) as f", "b / t as r2")


def multivariate_permutation(df: DataFrame, key: str, label: str, cols: list[str], reps: int, seed: int) -> DataFrame:
    """(f, r2, reps, exceed, p): pseudo-F of several columns between labels, against labels dealt out anew over all rows."""
    mean = df.agg(*(F.avg(c).alias(f"_{c}") for c in cols))
    mid = stash(df.select(key, label, *cols).crossJoin(F.broadcast(mean)).select(key, label, *((F.col(c) - F.col(f"_{c}")).alias(c) for c in cols)))  # one row of means
    own = _pseudo_f(mid, label, cols, []).select("f", "r2")
    null = _pseudo_f(permuted(mid, key, [], [label], cols, reps, seed), label, cols, ["rep"]).select(F.col("f").alias("fr"))
    hits = null.crossJoin(F.broadcast(own.select(F.col("f").alias("fo")))).agg(F.count("*").alias("reps"), F.count_if(F.expr("fr >= fo * (1 - 1e-9)")).alias("exceed"))
    return own.crossJoin(hits).selectExpr("f", "r2", "reps", "exceed", "(1 + exceed) / cast(reps + 1 as double) as p")  # rows of one


def cliffs_bootstrap(df: DataFrame, key: str, group: str, value: str, a, b, reps: int, seed: int) -> DataFrame:
    """(rep, delta): Cliff's delta of group a over b under Poisson row weights by hash."""
    x = weighted(df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(key, group, value), key, reps, seed).where("w > 0")
    at = x.groupBy("rep", F.col(value).alias("v")).agg(F.sum(F.when(F.col(group) == a, F.col("w")).otherwise(0)).alias("wa"), F.sum(F.when(F.col(group) == b, F.col("w")).otherwise(0)).alias("wb"))
    at = at.selectExpr("rep", "wa", "wb", "sum(wb) over (partition by rep order by v rows unbounded preceding) - wb as below")
    out = at.groupBy("rep").agg(F.sum("wa").alias("na"), F.sum("wb").alias("nb"), F.sum(F.expr("wa * (below + wb / 2.0d)")).alias("u"))
    return out.selectExpr("rep", "2 * u / nullif(na * nb, 0) - 1 as delta")


def rank_contrast(df: DataFrame, key: str, flag: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """(contrast, reps, p): Spearman's rho of flagged rows less that of the others, one-sided against flags dealt out anew."""
    own = df.select(key, F.col(flag).cast("int").alias("_f"), F.col(x).alias("_u"), F.col(y).alias("_v")).dropna()
    diff = lambda keys: [F.max(F.when(F.col("_f") == 1, F.col("rho"))).alias("r1"), F.max(F.when(F.col("_f") == 0, F.col("rho"))).alias("r0")]  # noqa: E731, ARG005
    seen = spearman(own, "_u", "_v", ["_f"]).agg(*diff([])).selectExpr("r1 - r0 as contrast")
    drawn = permuted(own, key, [], ["_f"], ["_u", "_v"], reps, seed)
    null = spearman(drawn, "_u", "_v", ["rep", "_f"]).groupBy("rep").agg(*diff(["rep"])).selectExpr("r1 - r0 as c")
    hits = null.crossJoin(F.broadcast(seen)).groupBy("contrast").agg(F.count("*").alias("reps"), F.count_if(F.expr("c <= contrast + 1e-12")).alias("hits"))  # one observed value
    return hits.selectExpr("contrast", "reps", "case when contrast is not null then (1 + hits) / cast(reps + 1 as double) end as p")


def block_subsample(sums: DataFrame, share: float, reps: int, seed: int) -> DataFrame:
    """(rep, mean): mean distance over pairs of blocks drawn by hash, ceil(share x blocks) of them; sums: (gi, gj, s, n), integer blocks."""
    blocks = sums.select(F.col("gi").alias("block")).distinct()
    total = blocks.agg(F.ceil(F.count("*") * share).alias("take"))
    x = replicates(blocks, reps).withColumn("_u", hash_uniform(seed, F.col("rep"), F.col("block")))
    x = x.selectExpr("rep", "block", "row_number() over (partition by rep order by _u, block) as place").crossJoin(F.broadcast(total)).where("place <= take")  # one number
    x = stash(x.select("rep", "block"))
    met = sums.join(x.withColumnRenamed("block", "gi"), "gi").join(x.withColumnRenamed("block", "gj"), ["rep", "gj"])
    return met.groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("mean"))


# --- distances: PERMANOVA, exact nulls ---------------------------------------------------------------


def permanova(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """(f, r2) from ordered sums of squared distances between groups (gi, gj, s) and group sizes (label, n)."""
    total = sums.agg(F.sum("s").alias("t"))
    within = sums.where("gi = gj").join(sizes, F.col("gi") == F.col("label")).agg(F.sum(F.expr("s / sizes_n")).alias("w"))
    n = sizes.agg(F.sum("sizes_n").alias("n"), F.count("*").alias("k"))
    return total.crossJoin(within).crossJoin(n).selectExpr("((t / n - w) / (k - 1)) / (w / (n - k)) as f", "1 - w / (t / n) as r2")


def stratified_null(sums: DataFrame, strata: DataFrame) -> DataFrame:
    """(expected, draws): expected mean distance of a sample matched by stratum, exactly.

    sums: ordered sums between strata (gi, gj, s); strata: (label, n, m) sizes and
    sampled sizes. Pairs within a stratum enter with m(m-1)/n(n-1), between strata
    with (m/n)(m'/n'); half the ordered sum, over the pairs of the sample.
    """
    a, b = strata.selectExpr("label as gi", "n as ni", "m as mi"), strata.selectExpr("label as gj", "n as nj", "m as mj")
    w = sums.join(a, "gi").join(b, "gj").selectExpr("case when gi <> gj then (mi / ni) * (mj / nj) * s when ni > 1 then (mi * (mi - 1)) / (ni * (ni - 1)) * s else 0.0d end as w")
    size = strata.agg(F.sum("m").alias("m"))
    return w.agg((F.sum("w") / 2).alias("w")).crossJoin(size).selectExpr("w / (m * (m - 1) / 2) as expected", "m as draws")


def leave_one_block_out(blocks: DataFrame) -> DataFrame:
    """(block, left): total distance without each block: total - row + half the diagonal, of ordered block sums (gi, gj, s) over unordered pairs."""
    rows = blocks.groupBy(F.col("gi").alias("block")).agg(F.sum("s").alias("row"), F.coalesce(F.sum(F.expr("case when gi = gj then s end")), F.lit(0.0)).alias("diag"))
    total = blocks.agg((F.sum("s") / 2).alias("total"))
    return rows.crossJoin(F.broadcast(total)).selectExpr("block", "total - row + diag / 2 as left")


def risk_ratio(df: DataFrame, exposed: str, event: str) -> DataFrame:
    """(a, b, c, d, ratio, low, high): risk ratio with log-normal bounds; null where a cell it needs is 0."""
    c = df.agg(F.count_if(F.expr(f"{exposed} and {event}")).alias("a"), F.count_if(F.expr(f"{exposed} and not {event}")).alias("b"), F.count_if(F.expr(f"not {exposed} and {event}")).alias("c"), F.count_if(F.expr(f"not {exposed} and not {event}")).alias("d"))
    ok = "a > 0 and c > 0"
    rr, se = "(a / (a + b)) / (c / (c + d))", "sqrt(1.0d / a - 1.0d / (a + b) + 1.0d / c - 1.0d / (c + d))"
    return c.selectExpr("a", "b", "c", "d", f"case when {ok} then {rr} end as ratio", f"case when {ok} then exp(ln({rr}) - 1.959963984540054d * {se}) end as low", f"case when {ok} then exp(ln({rr}) + 1.959963984540054d * {se}) end as high")


# --- resampling --------------------------------------------------------------------------------------------


def replicates(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))


def permuted_means(df: DataFrame, key: str, stratum: str, flag: str, value: str, reps: int, seed: int) -> DataFrame:
    """(rep, mean): mean value of as many hash-chosen rows in each stratum as are flagged there."""
    m = df.groupBy(stratum).agg(F.count_if(F.expr(flag)).alias("m"))
    x = replicates(df.join(m, stratum), reps).withColumn("u", hash_uniform(seed, F.col("rep"), F.col(key)))
    x = x.selectExpr("rep", value, "m", f"row_number() over (partition by rep, {stratum} order by u, {key}) as place").where("place <= m")
    return x.groupBy("rep").agg(F.avg(value).alias("mean"))


def permutation_p(null: DataFrame, observed: DataFrame, statistic: str) -> DataFrame:
    """(observed, reps, p): (1 + null at least as large) / (reps + 1)."""
    o = observed.select(F.col(statistic).alias("observed"))
    x = null.crossJoin(F.broadcast(o))  # one observed value
    return x.groupBy("observed").agg(F.count("*").alias("reps"), F.count_if(F.col(statistic) >= F.col("observed") - 1e-12).alias("hits")).selectExpr("observed", "reps", "(1 + hits) / cast(reps + 1 as double) as p")


def weighted(df: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """Rows of every replicate with a Poisson(1) weight w by hash of (seed, replicate, key)."""
    x = replicates(df, reps).withColumn("_u", hash_uniform(seed, F.col("rep"), F.col(key)))
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    weight = F.lit(8)
    for k in range(7, -1, -1):
        weight = F.when(F.col("_u") < steps[k], k).otherwise(weight)
    return x.withColumn("w", weight).drop("_u")


def poisson_bootstrap(df: DataFrame, key: str, value: str, keys: list[str], reps: int, seed: int) -> DataFrame:
    """(keys, rep, mean): bootstrap means with Poisson(1) row weights by hash: one pass, map-side sums, no resampling join."""
    x = weighted(df, key, reps, seed)
    return x.groupBy(*keys, "rep").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def interval(draws: DataFrame, value: str, keys: list[str], level: float = 0.95) -> DataFrame:
    q = (1 - level) / 2
    return draws.groupBy(*keys).agg(F.percentile(value, q).alias("low"), F.percentile(value, 1 - q).alias("high"), F.count("*").alias("reps")) if keys else draws.agg(F.percentile(value, q).alias("low"), F.percentile(value, 1 - q).alias("high"), F.count("*").alias("reps"))


# --- distribution tails ------------------------------------------------------------------------------------------


def chi2_tail(x: Column | str, df: Column | str) -> Column:
    """Upper tail of the chi-squared distribution of whole degrees of freedom, by its finite sum; null for null, 1 for x <= 0."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        def one(v: float, k: float) -> float | None:
            if not (v == v and k == k):
                return None
            if v <= 0:
                return 1.0
            h, odd = v / 2, int(k) % 2
            p = math.erfc(math.sqrt(h)) if odd else 0.0
            return min(1.0, p + sum(math.exp(a * math.log(h) - h - math.lgamma(a + 1)) for a in (i + odd / 2 for i in range(int(k) // 2))))

        return pd.Series([one(v, k) for v, k in zip(x, df, strict=True)], dtype="float64")

    return tail(x, df)


# --- tails of single figures, on the driver ----------------------------------------------------------------------------


def tails(spark) -> object:
    """Upper tails by the mathematics library that Spark ships: chi2(x, df), f(x, a, b), normal(z), t(x, df)."""
    d = spark.sparkContext._jvm.org.apache.commons.math3.distribution

    class Tails:
        chi2 = staticmethod(lambda x, k: 1 - d.ChiSquaredDistribution(float(k)).cumulativeProbability(float(x)))
        f = staticmethod(lambda x, a, b: 1 - d.FDistribution(float(a), float(b)).cumulativeProbability(float(x)))
        t = staticmethod(lambda x, k: 2 * (1 - d.TDistribution(float(k)).cumulativeProbability(abs(float(x)))))
        normal = staticmethod(lambda z: 2 * (1 - d.NormalDistribution().cumulativeProbability(abs(float(z)))))

    return Tails


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of a 2 x 2 table, by logs of factorials."""
    lf = math.lgamma
    n, r, k = a + b + c + d, a + b, a + c
    logp = lambda x: lf(r + 1) - lf(x + 1) - lf(r - x + 1) + lf(n - r + 1) - lf(k - x + 1) - lf(n - r - k + x + 1) - lf(n + 1) + lf(k + 1) + lf(n - k + 1)
    own = logp(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, k - (n - r)), min(r, k) + 1) if (p := logp(x)) <= own + 1e-9))
