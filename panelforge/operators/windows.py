"""Ranks, differences, multiplicity corrections, top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import stash


def _by(keys: list[str]) -> str:
    return f"partition by {', '.join(keys)}" if keys else ""


def ranks_of(counts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Rank distinct values: counts (keys, value, _t rows, ...) with _rank (ties at their mean), _below (rows under the value) and _n (all rows).

    No task sorts a whole group: values are dealt into ranges, counted inside each, and the
    ranges' totals (a row for each range and key) are added up. Rows with a null value or key are left out.
    """
    whole = counts.dropna(subset=[*keys, value])
    parts = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stash(whole.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_t").alias("_m"))
    sums = sums.selectExpr(*keys, "_part", f"sum(_m) over ({_by(keys)} order by _part) - _m as _before", f"sum(_m) over ({_by(keys)}) as _n")
    inside = dealt.selectExpr("*", f"sum(_t) over (partition by {', '.join([*keys, '_part'])} order by {value} rows unbounded preceding) - _t as _in")
    met = inside.join(sums, [*keys, "_part"])
    return met.selectExpr(*counts.columns, "_in + _before + (_t + 1) / 2.0d as _rank", "_in + _before as _below", "_n")


def counted(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias("_t"))


def _with_ranks(df: DataFrame, value: str, keys: list[str], column: Column, name: str) -> DataFrame:
    # written before the join: a value that very many rows share is then split over tasks
    ranks = stash(ranks_of(counted(df, value, keys), value, keys).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, value])), column.alias("_found")))
    on = [df[c].eqNullSafe(ranks[f"_k{i}"]) for i, c in enumerate([*keys, value])]
    return df.join(ranks, on, "left").select(*(df[c] for c in df.columns), F.col("_found").alias(name))


def average_rank(df: DataFrame, value: str, keys: list[str], name: str = "rank") -> DataFrame:
    """Ranks with ties at their mean; null for a null value."""
    return _with_ranks(df, value, keys, F.col("_rank"), name)


def percentile_max_desc(df: DataFrame, value: str, keys: list[str], name: str = "pct") -> DataFrame:
    """Share of rows at least as large (descending percentile, ties at the largest); null for a null value."""
    return _with_ranks(df, value, keys, (F.col("_n") - F.col("_below")) / F.col("_n"), name)


def difference(df: DataFrame, value: str, keys: list[str], order: str, lag: int = 1, name: str = "delta") -> DataFrame:
    """Change against the row ``lag`` places earlier; rows without one have null."""
    return df.selectExpr("*", f"{value} - lag({value}, {lag}) over ({_by(keys)} order by {order}) as {name}")


def index_to_first(df: DataFrame, value: str, keys: list[str], order: str, name: str = "index") -> DataFrame:
    """Value over the first one, times 100."""
    return df.selectExpr("*", f"100.0d * {value} / first_value({value}) over ({_by(keys)} order by {order}) as {name}")


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], tie: str, name: str = "q") -> DataFrame:
    """Reverse running minimum of p n / rank, at most 1."""
    by = _by(keys)
    x = df.selectExpr("*", f"{p} * count(*) over ({by}) / row_number() over ({by} order by {p}, {tie}) as _s", f"row_number() over ({by} order by {p}, {tie}) as _r")
    return x.selectExpr("*", f"least(1.0d, min(_s) over ({by} order by _r rows between current row and unbounded following)) as {name}").drop("_s", "_r")


def holm(df: DataFrame, p: str, keys: list[str], tie: str, name: str = "q") -> DataFrame:
    """Running maximum of (n - rank + 1) p, at most 1."""
    by = _by(keys)
    x = df.selectExpr("*", f"row_number() over ({by} order by {p}, {tie}) as _r", f"count(*) over ({by}) as _n")
    return x.selectExpr("*", f"least(1.0d, max((_n - _r + 1) * {p}) over ({by} order by _r rows between unbounded preceding and current row)) as {name}").drop("_r", "_n")


def centre_on_median(df: DataFrame, value: str, keys: list[str], name: str = "centred") -> DataFrame:
    """Value minus its group's median; rows with a null key are a group."""
    med = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.median(value).alias("_m"))
    met = df.join(med, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return met.withColumn(name, F.col(value) - F.col("_m")).select(*df.columns, name)


def top_k(df: DataFrame, k: int | Column, keys: list[str], order: str, name: str = "place") -> DataFrame:
    """First k rows of each group; the order must break ties."""
    return df.selectExpr("*", f"row_number() over ({_by(keys)} order by {order}) as {name}").where(F.col(name) <= k)


def top_fraction(df: DataFrame, fraction: float, keys: list[str], order: str, least: int = 2) -> DataFrame:
    """First ceil(fraction n) rows of each group, ``least`` at least."""
    x = df.selectExpr("*", f"row_number() over ({_by(keys)} order by {order}) as place", f"count(*) over ({_by(keys)}) as _n")
    return x.where(F.col("place") <= F.greatest(F.lit(least), F.ceil(F.col("_n") * fraction))).drop("_n")


def diversity_first(df: DataFrame, kinds: list[str], order: str, n: int) -> DataFrame:
    """n rows: the best of each kind first, then the best of the rest."""
    x = df.selectExpr("*", f"case when row_number() over (partition by {', '.join(kinds)} order by {order}) = 1 then 0 else 1 end as _later")
    return x.orderBy("_later", *(F.expr(o.strip().removesuffix(" desc")).desc() if o.strip().endswith(" desc") else F.expr(o.strip()) for o in order.split(","))).limit(n).drop("_later")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return top_k(df, 1, keys, order).drop("place")


def pareto_front(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows no other row dominates (both values at least as large, one larger).

    A row is on the front if its b exceeds every b at larger a, and is the largest at its own a. The
    running maximum is taken in ranges of a and carried over from range to range (a row each); no pairs are made.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    best = stash(df.groupBy(a).agg(F.max(b).alias("_b")).repartitionByRange(parts, a).withColumn("_part", F.spark_partition_id()))
    tops = best.groupBy("_part").agg(F.max("_b").alias("_m")).selectExpr("_part", "max(_m) over (order by _part desc rows between unbounded preceding and 1 preceding) as _over")
    near = best.selectExpr(a, "_b", "_part", f"max(_b) over (partition by _part order by {a} desc rows between unbounded preceding and 1 preceding) as _above")
    sky = stash(near.join(tops, "_part").where("greatest(_above, _over) is null or _b > greatest(_above, _over)").select(F.col(a).alias("_a"), "_b"))
    return df.join(sky, (df[a] == F.col("_a")) & (df[b] == F.col("_b")), "left").select(*(df[c] for c in df.columns), F.col("_b").isNotNull().alias("on_front"))
