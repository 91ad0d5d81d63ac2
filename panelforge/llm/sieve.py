"""Sieve rows by a key before a shuffle, in DataFrame operations only.

A semi- or anti-join against a key list shuffles all rows unless the list is small.
Here the list is first written into a bit array of bounded size (two bits
a key), which reaches the rows as a scalar subquery; only rows whose bits are set take
part in the exact join. More keys than the array is made for let more rows
through to the join; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the bit array: about a word for four keys, 8 MB at most.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 20


def _places(h: Column, words: int) -> tuple[Column, Column]:
    a = F.xxhash64(h)
    bits = words * 64
    return F.pmod(a, F.lit(bits)), F.pmod(F.xxhash64(a, F.lit(1)), F.lit(bits))


def maybe_in(keys: DataFrame, key: str) -> callable:
    """A function of a bigint column: false only if the value is in no row of ``keys``."""
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (keys.count() // 4).bit_length()))
    spread = keys.select(F.explode(F.array(*_places(F.col(key), words))).alias("p"))
    held = spread.groupBy(F.floor(F.col("p") / 64).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("w"))
    whole = keys.sparkSession.range(words).join(held, "id", "left").select("id", F.coalesce("w", F.lit(0)).alias("w"))
    bits = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]).alias("bits")).scalar()

    def test(h: Column) -> Column:
        one = lambda p: F.getbit(F.element_at(bits, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
        a, b = _places(h, words)
        return one(a) & one(b)

    return test


def semi(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key columns are in ``keys`` (distinct, stashed); null keys match null keys."""
    test = maybe_in(keys.select(F.xxhash64(*on).alias("h")), "h")
    return _joined(rows.where(test(F.xxhash64(*on))), keys, on, "left_semi")


def anti(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key columns are not in ``keys`` (distinct, stashed); most never meet the join."""
    test = maybe_in(keys.select(F.xxhash64(*on).alias("h")), "h")
    h = F.xxhash64(*on)
    return rows.where(~test(h)).unionByName(_joined(rows.where(test(h)), keys, on, "left_anti"))


def _joined(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    other = keys.select(*(F.col(c).alias(f"{c}_key") for c in on))
    match = F.lit(True)
    for c in on:
        match = match & rows[c].eqNullSafe(other[f"{c}_key"])
    return rows.join(other, match, how)
