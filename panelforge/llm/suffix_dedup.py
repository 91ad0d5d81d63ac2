"""Repeated passages by sparse suffixes.

Every window of ``min_words`` words hangs on one place: the first least word k-gram
(K words) among its first W. That depends on the window's own words only, so copies of
a window hang on copies of the place, whatever stands around them. Windows on one
place follow one another and form a region, one row.

The first scan counts the places' keys (a hash of KEY words from there on, all inside
the window; combined before the shuffle); places whose key one document alone has
go no further, so what is shuffled follows the repeated text. The others' regions
are grouped by their words: a region that two documents have is a match as a whole.
The windows of each distinct region are grouped next, and settle which windows of the
regions of one document are elsewhere too. Both are plain groups by hash, so every
window meets every other copy. Touching spans are joined.

Sorting the suffixes by what follows and comparing neighbours alone would lose passages: of
two copies that agree mostly to the left of the place, other rows may sort in between.
Grouping by whole windows instead extends every match as far as its words agree, both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import _BASE, U64, bloom_of, column, mix, settle, stash, text_slices, tidy, words_of

K, W, KEY = 8, 16, 32
_NO_ID = -(1 << 63)


def doubling_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in about 2 log2(k) passes."""
    m = max(0, len(words) - k + 1)
    out, done = np.zeros(m, np.uint64), 0
    h, base, size = words, _BASE, 1
    while m:
        if k & size:
            out = out * U64(base) + h[done:done + m]
            done += size
        if done == k:
            break
        h = h[:-size] * U64(base) + h[size:]
        base = base * base % (1 << 64)
        size *= 2
    return mix(out)


def _first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of x[i : i + width] for each whole i, width a power of two."""
    at, size = np.arange(len(x)), 1
    while size < width:
        less = x[size:] < x[:-size]
        x, at = np.where(less, x[size:], x[:-size]), np.where(less, at[size:], at[:-size])
        size *= 2
    return at


def _regions(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Regions of the texts: (text, first word within it, windows, key, hash of all their windows of ``size`` words end to end)."""
    words, first, _ = words_of(data, offs)
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(text[:max(0, n - size + 1)] == text[size - 1:])
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = _first_least(doubling_hash(words, K), W)[start]
    head = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(head, len(start)))
    begin = start[head]
    return text[begin], begin - first[text[begin]], count, doubling_hash(words, KEY)[place[head]], doubling_hash(words, size)[start]


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Passages of at least ``min_words`` words that another document has too (A-Z lower-cased).

    Columns doc_id, start_word, end_word (end exclusive), n_words and partner_id (a document that has
    a part of at least ``min_words`` words of it), one row for each maximal span; documents
    without a repeat have no row. Rows with one id are one document (a repeat inside
    a document alone doesn't count); rows with a null id are one document with a
    null id. Null, empty and short texts have no passages; very long texts are read whole;
    several partners of a span give one of them. Other columns are ignored; an empty
    table gives an empty result. ``min_words`` is at least KEY + W - 1.
    """
    if min_words < KEY + W - 1:
        raise ValueError(f"min_words must be at least {KEY + W - 1}")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offs in text_slices(b, "text"):
                text, _, _, key, _ = _regions(data, offs, min_words)
                ids = column(rows, "doc_id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[text])], ["key", "doc"])

    repeated = docs.mapInArrow(tidy(keys), "key bigint, doc bigint").groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi")
    sieve = spark.sparkContext.broadcast(bloom_of(repeated, "key", 1 << 26))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offs in text_slices(b, "text"):
                text, start, count, key, windows = _regions(data, offs, min_words)
                hit = sieve.value.hit(key)
                if not hit.any():
                    continue
                windows = windows[np.repeat(hit, count)]
                text, start, count = text[hit], start[hit], count[hit]
                ends = np.concatenate(([0], np.cumsum(count)))
                # the first and the last window hold all words of the region
                region = mix(windows[ends[:-1]] * U64(_BASE) + windows[ends[1:] - 1] + count.astype(np.uint64))
                ids = column(rows, "doc_id").to_numpy()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(windows.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(ids[text]), pa.array(start), lists], ["region", "doc", "start", "windows"])

    rows = stash(docs.mapInArrow(tidy(rows_of), "region bigint, doc bigint, start bigint, windows array<bigint>"))
    regions = stash(rows.groupBy("region").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("windows").alias("windows")))
    # windows of a region that one document alone has may be in other regions
    each = regions.select("region", "lo", "hi", F.posexplode("windows").alias("k", "window"))
    shared = each.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.expr("lo = hi")).alias("open"))
    shared = stash(shared.where("lo <> hi and open").drop("open"))
    found = spark.sparkContext.broadcast(bloom_of(shared, "window", 1 << 26))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(found.value.hit(column(b, "window").to_numpy().view(np.uint64))))

    lone = each.where("lo = hi").select("region", F.col("lo").alias("doc"), "k", "window").mapInArrow(tidy(passed), "region bigint, doc bigint, k int, window bigint")
    part = lone.join(shared, "window").groupBy("region").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.min(F.expr("if(lo <> doc, lo, hi)")).alias("lo")).withColumn("hi", F.col("lo"))
    whole = regions.where("lo <> hi").select("region", F.lit(0).alias("low"), (F.size("windows") - 1).alias("high"), "lo", "hi")
    # written before the join: a region that very many documents have is then split over tasks
    marks = stash(whole.unionByName(part))
    spans = rows.select("region", "doc", "start").join(marks, "region")
    # windows of one region overlap: their first and last bound one span
    spans = spans.selectExpr("doc", "start + low as start", f"start + high + {min_words} as stop", "if(lo <> doc, lo, hi) as partner")

    spans = spans.selectExpr("*", "max(stop) over (partition by doc order by start, stop rows between unbounded preceding and 1 preceding) as before")
    spans = spans.selectExpr("*", "sum(cast(before is null or start > before as int)) over (partition by doc order by start, stop rows unbounded preceding) as span")
    out = spans.groupBy("doc", "span").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("partner").alias("partner_id"))
    out = out.select(F.expr("case when doc = -9223372036854775808 then null else doc end").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.expr("case when partner_id = -9223372036854775808 then null else partner_id end").alias("partner_id"))
    return settle(out, rows, regions, shared, marks)
