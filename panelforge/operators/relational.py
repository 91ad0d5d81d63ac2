"""Relational idioms with their contracts: cardinality-checked joins, lineage matching, code and name crosswalks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over


def require_unique(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """``df`` unchanged; a key that occurs twice is an error when the plan runs."""
    n = F.count("*").over(over(*keys))
    kind = dict(df.dtypes)[keys[0]]
    return df.withColumn(keys[0], F.when(n == 1, F.col(keys[0])).otherwise(F.raise_error(F.lit(f"{side} keys are not unique")).cast(kind)))


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "one_to_one") -> DataFrame:
    """Join whose declared 'one' sides are checked: one_to_one, many_to_one, one_to_many or many_to_many."""
    a, b = validate.split("_to_")
    left = require_unique(left, keys, "left") if a == "one" else left
    right = require_unique(right, keys, "right") if b == "one" else right
    return left.join(right, keys, how)


def outer_fold(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of any number of tables on one unique key."""
    return reduce(lambda a, b: a.join(b, key, "full"), (require_unique(t, [key], "table") for t in tables))


def with_indicator(left: DataFrame, right: DataFrame, keys: list[str], name: str = "status") -> DataFrame:
    """Left join with MATCHED or MISSING."""
    marked = right.withColumn("_hit", F.lit(True))
    return left.join(marked, keys, "left").withColumn(name, F.when(F.col("_hit"), "MATCHED").otherwise("MISSING")).drop("_hit")


def audited_join(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left join with a null-safe equality flag for each shared field and one for all."""
    other = right.select(key, *(F.col(f).alias(f"{f}_other") for f in fields), F.lit(True).alias("_hit"))
    out = left.join(other, key, "left")
    same = {f: F.col("_hit").isNotNull() & F.col(f).eqNullSafe(F.col(f"{f}_other")) for f in fields}
    return out.select(key, *(c.alias(f"{f}_same") for f, c in same.items()), reduce(lambda a, b: a & b, same.values()).alias("all_same"))


def fingerprints(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, n, digest): SHA-256 of a key's records, sorted and joined by newlines."""
    record = F.concat_ws("|", *(F.col(f).cast("string") for f in fields))
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(record)), "\n"), 256).alias("digest"))


def exact_lineage(current: DataFrame, official: DataFrame, key: str, official_key: str, fields: list[str]) -> DataFrame:
    """(key, candidates, official_key): the official trajectory equal to each key's, if there is exactly one."""
    a, b = fingerprints(current, key, fields), fingerprints(official, official_key, fields)
    met = a.join(b.select("digest", official_key), "digest", "left").groupBy(key).agg(F.count(official_key).alias("candidates"), F.min(official_key).alias("found"))
    return met.select(key, "candidates", F.when(F.col("candidates") == 1, F.col("found")).alias(official_key))


def contained_lineage(current: DataFrame, official: DataFrame, key: str, official_key: str, fields: list[str]) -> DataFrame:
    """(official_key, key): official record multisets contained in a key's multiset, where only one key contains it."""
    a = current.groupBy(key, *fields).agg(F.count("*").alias("have"))
    b = official.groupBy(official_key, *fields).agg(F.count("*").alias("need"))
    size = b.groupBy(official_key).agg(F.count("*").alias("records"))
    met = b.join(a, fields).where("have >= need").groupBy(official_key, key).agg(F.count("*").alias("hit")).join(size, official_key).where("hit = records")
    return met.groupBy(official_key).agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n = 1").select(official_key, key)


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b (with multiplicity), equal."""
    x = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    y = b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return x.crossJoin(y).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def collapse_agreeing(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, value, name, status): accepted if the key has one distinct non-null value and one distinct name."""
    x = df.groupBy(key).agg(F.count_distinct(value).alias("values"), F.count_distinct(name).alias("names"), F.min(value).alias("_v"), F.min(name).alias("_n"))
    ok = (F.col("values") == 1) & (F.col("names") == 1)
    why = F.when(ok, "accepted").when(F.col("values") == 0, "no_value").when(F.col("values") > 1, "value_conflict").otherwise("name_conflict")
    return x.select(key, F.when(ok, F.col("_v")).alias(value), F.when(ok, F.col("_n")).alias(name), why.alias("status"))


def code_11_to_8(codes: DataFrame, key: str, code: str, known: DataFrame) -> DataFrame:
    """(key, code8, reason): strip hyphens; 11 digits ending in 000 give their first 8; known and claimed once, or a reason."""
    plain = F.regexp_replace(code, "-", "")
    x = codes.select(key, plain.alias("p")).withColumn("c8", F.when(F.col("p").rlike("^[0-9]{11}$") & F.col("p").endswith("000"), F.substring("p", 1, 8)))
    x = x.join(known.select(F.col(known.columns[0]).alias("c8"), F.lit(True).alias("_known")), "c8", "left").withColumn("claims", F.count("c8").over(over("c8")))
    reason = (
        F.when(F.col("p").isNull(), "missing").when(~F.col("p").rlike("^[0-9]{11}$"), "not_11_digits").when(~F.col("p").endswith("000"), "not_a_whole_unit")
        .when(F.col("_known").isNull(), "unknown_code").when(F.col("claims") > 1, "many_to_one_conflict").otherwise("ok")
    )
    return x.select(key, F.when(reason == "ok", F.col("c8")).alias("code8"), reason.alias("reason"))


def conservative_crosswalk(names: DataFrame, entities: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, candidates, entity, status): a manual override decides; otherwise nothing is matched, only counted."""
    n = entities.groupBy("normal").agg(F.count("*").alias("candidates"))
    x = names.join(n, "normal", "left").join(overrides.select("name", F.col("entity")), "name", "left")
    status = F.when(F.col("entity").isNotNull(), "override").when(F.col("candidates").isNull(), "blocked_no_candidate").when(F.col("candidates") == 1, "blocked_unreviewed").otherwise("blocked_ambiguous")
    return x.select("name", F.coalesce("candidates", F.lit(0)).alias("candidates"), "entity", status.alias("status"))


def provenance(data: DataFrame, key: str, indicators: list[str], sources: DataFrame) -> DataFrame:
    """(key, indicator, value, source): a row for each non-null indicator."""
    long = data.select(key, *(F.col(c).cast("double") for c in indicators)).unpivot([key], indicators, "indicator", "value").where("value is not null")
    return long.join(sources, "indicator", "left").select(key, "indicator", "value", F.coalesce("source", F.lit("unknown")).alias("source"))


def coverage(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row: keys, covered, share, and the first missing ones as text (a report of at most 20)."""
    x = keys.join(df.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    missing = x.where("_hit is null").orderBy(key).limit(20).agg(F.nullif(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ","), F.lit("")).alias("missing"))
    return x.agg(F.count("*").alias("n"), F.count("_hit").alias("covered")).withColumn("share", F.col("covered") / F.col("n")).crossJoin(missing)


def first_non_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """``identity`` and ``identity_source``: first column that is not null or blank."""
    filled = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns}
    source = F.coalesce(*(F.when(v.isNotNull(), F.lit(c)) for c, v in filled.items()))
    return df.withColumn("identity", F.coalesce(*filled.values())).withColumn("identity_source", source)


def dummies(df: DataFrame, key: str, column: str, levels: list) -> DataFrame:
    """Treatment coding: an indicator for each level but the first in order."""
    return df.select(key, *(F.when(F.col(column) == v, 1).otherwise(0).alias(f"{column}_{v}") for v in sorted(levels)[1:]))


def within_tolerance(results: DataFrame, expected: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(keys, actual, expected, ok): |a - b| <= tolerance * max(1, |b|); a missing side fails."""
    x = results.withColumnRenamed("value", "actual").join(expected.withColumnRenamed("value", "expected"), keys, "full")
    return x.select(*keys, "actual", "expected", F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance * F.greatest(F.lit(1.0), F.abs("expected")), F.lit(False)).alias("ok"))
