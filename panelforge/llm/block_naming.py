"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of characters. The distinct blocks are
sorted and their place in the sort is their integer name; adjacent names are
paired, the distinct pairs sorted and named in turn, and so on until each
row has one name. Names are equal if and only if the texts are: each level
names values, not hashes, so there is nothing to collide.

A text whose (length, 64-bit hash) no other row has can't equal another text
(unequal hashes prove unequal texts), so it has its own identity from the start and
its blocks are not moved. Every group the hash suggests is decided by naming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import release, settle, stash
from .sieve import anti, semi

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that where each character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _named(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct rows of ``keys``, sorted; ``name``: their ascending integer names from 1.

    Sorted by a 64-bit hash, then the values: the driver's sample for the ranges is
    8 bytes a row however long a block is. The values decide, so names can't collide.
    """
    order = keys.select(*cols).distinct().withColumn("_order", F.xxhash64(*cols))
    order = order.repartitionByRange("_order").sortWithinPartitions("_order", *cols)
    # stashed: a name is fixed once, whatever is run again later
    return stash(order.select(*cols, (F.monotonically_increasing_id() + 1).alias("name")))


def block_naming_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z only.

    One row per input row: doc_id, keep_id (the largest doc_id of the group),
    group_size (rows), kept (is this row's id the one that stays), text_sha256
    (lowercase hex of the normalised text in UTF-8). A null text counts as empty;
    all empty texts are one group; a very long text is cut into blocks like any
    other. Rows that repeat id and text are all counted and carry the same values. A
    null doc_id is never kept while its group has a non-null one. Other columns are
    ignored; an empty table gives an empty result.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), norm.alias("norm"))
    rows = stash(docs.select("doc_id", F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("len"), F.sha2("norm", 256).alias("sha")))
    again = stash(rows.groupBy("h", "len").agg(F.count("*").alias("n")).where("n > 1").select("h", "len"))
    # only texts that may be in such a group are shuffled; each row of them has a number from here on
    texts = semi(docs.select("doc_id", "norm", F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("len")), again, ["h", "len"])
    # (?s).{1,n} cuts in one pass over the text; an empty text is one empty block
    cut = F.when(F.col("len") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("sha"), cut.alias("cut"))
    blocks = stash(numbered.select("row", "doc_id", "sha", F.posexplode("cut").alias("i", "block")))
    heads = stash(blocks.where("i = 0").select("row", "doc_id", "sha"))

    names = _named(blocks, "block")
    level = stash(blocks.join(names, "block").select("row", "i", "name"))
    release(names, blocks)
    while (level.agg(F.max("i")).first()[0] or 0) > 0:
        at = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = stash(level.groupBy("row", F.floor(F.col("i") / 2).alias("i")).agg(at(0).alias("left"), F.coalesce(at(1), F.lit(0)).alias("right")))
        names = _named(pairs, "left", "right")
        step = stash(pairs.join(names, ["left", "right"]).select("row", "i", "name"))
        release(level, pairs, names)
        level = step

    tied = stash(heads.join(level, "row").select("doc_id", "sha", "name"))
    # written before the join: a name that very many rows have is then split over tasks
    groups = stash(tied.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    alone = anti(rows, again, ["h", "len"]).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha")
    out = alone.unionByName(tied.join(groups, "name").select("doc_id", "keep_id", "group_size", "sha"))
    out = out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    return settle(out, rows, again, level, heads, tied, groups)
