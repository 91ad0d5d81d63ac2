"""Strict panels and compositional features."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import settle, stash
from ..functions.columns import MAD_SCALE, over
from .pairs import median_pair_distance


@dataclass
class StrictPanel:
    """rows of the strict units; units (unit, idx in name order); one-row audit."""

    panel: DataFrame
    units: DataFrame
    audit: DataFrame


def _check_calendar(raw: DataFrame, period: str, expected: list) -> None:
    found = {r[0] for r in raw.select(period).distinct().limit(10 * len(expected) + 1000).collect()}
    if found != set(expected):
        raise ValueError(f"calendar differs from the expected one: missing {sorted(set(expected) - found)[:5]}, unexpected {sorted(found - set(expected))[:5]}")


def ambiguous_units(raw: DataFrame, unit: str, category: str, period: str) -> DataFrame:
    """Units with more than one row for some (category, period)."""
    return raw.groupBy(unit, category, period).agg(F.count("*").alias("n")).where("n > 1").select(unit).distinct()


def complete_units(raw: DataFrame, unit: str, category: str, period: str, categories: list, n_periods: int) -> DataFrame:
    """Units that have every required category in every period."""
    seen = raw.where(F.col(category).isin(categories)).groupBy(unit, category).agg(F.count_distinct(period).alias("n"))
    return seen.where(F.col("n") == n_periods).groupBy(unit).agg(F.count("*").alias("k")).where(F.col("k") == len(categories)).select(unit)


def complete_rows(cells: DataFrame, categories: list, n_periods: int) -> DataFrame:
    """Rows of the complete units of a table with one row for each (unit, t, category): no second scan, no join."""
    wanted = F.count_if(F.col("category").isin(categories)).over(over("unit"))
    return cells.withColumn("_n", wanted).where(F.col("_n") == len(categories) * n_periods).drop("_n")


def numbered(units: DataFrame, key: str) -> DataFrame:
    """(key, idx): place of each key in the sorted list, from per-range counts and row numbers (no single-task sort)."""
    keys = units.select(key).distinct()
    dealt = keys.repartitionByRange(max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    dealt = stash(dealt.withColumn("seq", F.monotonically_increasing_id()))  # read twice: the numbers must be the same
    heads = dealt.groupBy("part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = heads.selectExpr("part", "first", "sum(n) over (order by part) - n as offset")
    return dealt.join(F.broadcast(before), "part").select(key, (F.col("seq") - F.col("first") + F.col("offset")).alias("idx"))


def strict_panel(raw: DataFrame, *, categories: list, periods: list, unit: str = "unit", category: str = "category", period: str = "t") -> StrictPanel:
    """Complete and unambiguous units of a long table.

    The calendar is checked on all rows (an error if it differs), ambiguity over all
    categories, completeness over the required ones only.
    """
    _check_calendar(raw, period, periods)
    doubtful = ambiguous_units(raw, unit, category, period)
    whole = complete_units(raw, unit, category, period, categories, len(periods))
    strict = whole.join(doubtful, unit, "left_anti")
    panel = raw.join(strict, unit, "left_semi")
    audit = raw.agg(F.count("*").alias("raw_rows"), F.count_distinct(unit).alias("units"), F.count_distinct(period).alias("periods")).crossJoin(
        doubtful.agg(F.count("*").alias("ambiguous"))).crossJoin(whole.agg(F.count("*").alias("complete"))).crossJoin(strict.agg(F.count("*").alias("strict")))
    return StrictPanel(panel, numbered(strict, unit), audit)


def shares(panel: DataFrame) -> DataFrame:
    """(unit, t, category, value, total, share) with closure within (unit, t); a total <= 0 is an error."""
    total = F.sum("value").over(over("unit", "t"))
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("totals must be positive")).cast("double"))
    return panel.select("unit", "t", "category", "value", checked.alias("total")).withColumn("share", F.col("value") / F.col("total"))


def with_residual(panel: DataFrame, selected: list[str], total: str, name: str = "Other") -> DataFrame:
    """Selected parts and the residual of a given total as a further part."""
    parts = panel.where(F.col("category").isin(selected)).select("unit", "t", "category", "value")
    sums = panel.groupBy("unit", "t").agg((F.sum(F.when(F.col("category") == total, F.col("value"))) - F.coalesce(F.sum(F.when(F.col("category").isin(selected), F.col("value"))), F.lit(0.0))).alias("value"))
    return parts.unionByName(sums.select("unit", "t", F.lit(name).alias("category"), "value"))


def clr_parts(panel: DataFrame, value: str = "value") -> DataFrame:
    """(unit, t, category, clr): closure cancels in a log-ratio, so raw positive values serve."""
    logs = F.when(F.col(value) > 0, F.log(value)).otherwise(F.raise_error(F.lit("composition parts must be positive")).cast("double"))
    return panel.select("unit", "t", "category", logs.alias("ln")).select("unit", "t", "category", (F.col("ln") - F.avg("ln").over(over("unit", "t"))).alias("clr"))


def robust_z(df: DataFrame, value: str, *keys: str, name: str = "z") -> DataFrame:
    """(x - median) / (1.4826 MAD) within keys, as aggregates joined back; MAD 0 is an error."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_med"))
    near = df.join(med, list(keys)) if keys else df.crossJoin(med)
    mad = near.groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("_med"))) * MAD_SCALE).alias("_mad"))
    out = near.join(mad, list(keys)) if keys else near.crossJoin(mad)
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(F.raise_error(F.lit("zero MAD")).cast("double"))
    return out.withColumn(name, (F.col(value) - F.col("_med")) / scale).drop("_med", "_mad")


def robust_level(panel: DataFrame) -> DataFrame:
    """(unit, t, z): robust z of the log total within each period."""
    totals = panel.groupBy("unit", "t").agg(F.log(F.sum("value")).alias("ln_total"))
    return robust_z(totals, "ln_total", "t").select("unit", "t", "z")


def vectors(long: DataFrame, value: str, name: str = "vec") -> DataFrame:
    """(unit, t, vec): parts in name order as an array."""
    return long.groupBy("unit", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("category", value))), lambda x: x[value]).alias(name))


def features(panel: DataFrame, structure_weight: float = 0.7, level_weight: float = 0.3) -> DataFrame:
    """(unit, t, vec): CLR block and level, each over its median pairwise distance, times the root of its weight.

    The panel is written once; both blocks' medians are selected in the same passes.
    """
    panel = stash(panel)
    structure = vectors(clr_parts(panel), "clr")
    level = robust_level(panel).select("unit", "t", F.array("z").alias("lvl"))
    blocks = stash(structure.select((F.col("t") * 2).alias("g"), "unit", "vec").union(level.select(F.col("t") * 2 + 1, "unit", "lvl")))
    scale = median_pair_distance(blocks, "g", "unit", "vec").groupBy(F.floor(F.col("g") / 2).cast("int").alias("t")).agg(
        F.max(F.when(F.col("g") % 2 == 0, F.col("distance"))).alias("sa"), F.max(F.when(F.col("g") % 2 == 1, F.col("distance"))).alias("sb"))
    a, b = blocks.where("g % 2 = 0").selectExpr("unit", "cast(g / 2 as int) as t", "vec"), blocks.where("g % 2 = 1").selectExpr("unit", "cast((g - 1) / 2 as int) as t", "vec as lvl")
    both = a.join(b, ["unit", "t"]).join(scale, "t")
    scaled = lambda v, s, w: F.transform(F.col(v), lambda x: x * (w**0.5) / F.col(s))
    return settle(both.select("unit", "t", F.concat(scaled("vec", "sa", structure_weight), scaled("lvl", "sb", level_weight)).alias("vec")), panel, blocks)


def combine_blocks(blocks: list[tuple[DataFrame, float]], group: str, key: str) -> DataFrame:
    """(group, key, vec): any number of vector blocks, each over its median distance and weighted."""
    def scaled(df: DataFrame, w: float, k: int) -> DataFrame:
        s = median_pair_distance(df, group, key, "vec")
        return df.join(s, group).select(group, key, F.transform("vec", lambda x: x * (w**0.5) / F.col("distance")).alias(f"b{k}"))

    parts = [scaled(df, w, k) for k, (df, w) in enumerate(blocks)]
    whole = reduce(lambda a, b: a.join(b, [group, key]), parts)
    return whole.select(group, key, F.concat(*(f"b{k}" for k in range(len(parts)))).alias("vec"))


def log_levels(panel: DataFrame) -> DataFrame:
    """Alternative representation: robust z of each part's log level within (period, category)."""
    return robust_z(panel.select("unit", "t", "category", F.log("value").alias("ln")), "ln", "t", "category").select("unit", "t", "category", "z")


def composition_volatility(panel: DataFrame) -> DataFrame:
    """(unit, volatility): root mean square deviation of CLR changes from their mean over (period, part)."""
    change = clr_parts(panel).selectExpr("unit", "category", "clr - lag(clr) over (partition by unit, category order by t) as d").where("d is not null")
    return change.selectExpr("unit", "d - avg(d) over (partition by unit, category) as e").groupBy("unit").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("volatility"))


def total_volatility(panel: DataFrame) -> DataFrame:
    """(unit, volatility): sample deviation of log-total changes."""
    totals = panel.groupBy("unit", "t").agg(F.log(F.sum("value")).alias("ln"))
    return totals.selectExpr("unit", "ln - lag(ln) over (partition by unit order by t) as d").groupBy("unit").agg(F.stddev_samp("d").alias("volatility"))


def aitchison(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Aitchison distance of matching compositions (keys, category, clr)."""
    both = left.join(right.withColumnRenamed("clr", "clr2"), [*keys, "category"])
    return both.groupBy(*keys).agg(F.sqrt(F.sum((F.col("clr") - F.col("clr2")) * (F.col("clr") - F.col("clr2")))).alias("distance"))


def snapshot(directory: DataFrame, year: int, key: str, start: str = "year_from", end: str = "year_to") -> DataFrame:
    """Rows valid in a year, [from, to); a key with two valid rows is an error."""
    rows = directory.where((F.col(start) <= year) & (F.col(end) > year))
    n = F.count("*").over(over(key))
    return rows.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.lit("snapshot key is not unique")).cast(dict(directory.dtypes)[key])))


def first_reason(checks: list[tuple[str, str]], name: str = "reason"):
    """First failing check's name, or 'eligible'; checks are (reason, SQL condition that must hold)."""
    expr = F.lit("eligible")
    for reason, condition in reversed(checks):
        expr = F.when(~F.coalesce(F.expr(condition), F.lit(False)), reason).otherwise(expr)
    return expr.alias(name)
