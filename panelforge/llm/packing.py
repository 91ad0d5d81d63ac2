"""Packing by optimal length buckets.

The histogram of sequence lengths over all rows goes to a dynamic program that
chooses bucket bounds with the least padding in total; inside each bucket,
batches are filled up to a token budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import _SPACE, column, settle, stash, text_slices, tidy

#: Bytes of a word that one token stands for in the estimate of a text's length: with the 50k
#: vocabulary, 97 % of the sf0.01 documents have at most so many tokens.
PIECE = 2


def token_estimates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length) of each whole text: every word [^\\x20\\x09-\\x0D]+ counts one for each PIECE bytes begun.

    A text without blanks, however long, is thus as long as its bytes say. Null, empty
    and blank texts: 0. Rows keep their number; null ids and repeated rows stay; other columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offs in text_slices(b, "text"):
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(pieces(data, offs))], ["doc_id", "length"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, length bigint")


def pieces(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Estimated tokens of each text: sum over its words of ceil(bytes / PIECE)."""
    blank = _SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = blank[:-1]
    first[offs[:-1][offs[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & ~blank)
    place = np.arange(len(data))
    # a piece begins at every PIECE-th byte of a word
    since = place - starts[np.maximum(np.searchsorted(starts, place, "right") - 1, 0)] if len(starts) else place
    sums = np.concatenate(([0], np.cumsum(~blank & (since % PIECE == 0))))
    return (sums[offs[1:]] - sums[offs[:-1]]).astype(np.int64)


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most ``buckets`` runs of ascending distinct lengths with the least padding in total, and that padding.

    Exact dynamic program in whole numbers. With k buckets up to length j, the last
    of them starting after i, the cost is lengths[j] times the rows in between, less their sum:
    for a given i a straight line in lengths[j], so the least over i is read off a lower hull, in
    O(buckets x lengths) time.
    """
    m = len(lengths)
    if not m:
        return [], 0
    rows, total = [0], [0]
    for x, n in zip(lengths, counts, strict=True):
        rows.append(rows[-1] + n)
        total.append(total[-1] + n * x)
    best: list[int | None] = [0] + [None] * m  # with no bucket, only no length is covered
    back = []
    for _ in range(min(buckets, m)):
        now: list[int | None] = list(best)
        came = [-1] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, height, i) of lines that are lowest somewhere, slopes falling
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                line = (-rows[j - 1], best[j - 1] + total[j - 1], j - 1)
                while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            cost = hull[at][0] * x + hull[at][1] + rows[j] * x - total[j]
            if now[j] is None or cost < now[j]:
                now[j], came[j] = cost, hull[at][2]
        back.append(came)
        if now == best:
            break
        best = now
    out, j = [], m
    for came in reversed(back):
        if j and came[j] >= 0:
            out.append(lengths[j - 1])
            j = came[j]
    return out[::-1], best[m]


def pack(lengths: DataFrame, *, id_col: str = "doc_id", length_col: str = "length", buckets: int = 16, budget: int = 32768, slice_rows: int = 50_000) -> DataFrame:
    """Length bucket and token-budget batch of each row.

    doc_id, length, bucket (0 on), bucket_len (the length its rows are padded to),
    batch_id (unique over the buckets), slot (place in the batch), padding. A batch
    holds max(1, budget // bucket_len) rows; within a bucket, rows are taken by a hash of the
    id (then id), so that batches mix sources. Length 0 rows fall in the first bucket;
    null lengths count as 0. Rows keep their number; ties and repeated rows each get
    a slot; a row longer than the budget is a batch of its own; other columns are
    ignored; an empty table gives an empty result.

    Ranks inside a bucket are counted over slices of about ``slice_rows`` rows and added
    up, so a bucket that holds most of the corpus isn't one task's work. Slice totals stay
    in Spark. The driver gets the histogram, a row for each distinct length: of a corpus of T
    tokens at most sqrt(2 T), as distinct lengths add up to T at most.
    """
    rows = stash(lengths.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)).alias("length")))
    bins = sorted((r.length, r.n) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    bounds, _ = best_bounds([x for x, _ in bins], [n for _, n in bins], buckets)
    total = sum(n for _, n in bins)
    slices = max(1, -(-total // slice_rows))
    bounds = bounds or [0]
    places = F.array(*map(F.lit, bounds))
    bucket = F.size(F.filter(places, lambda x: x < F.col("length")))
    keyed = rows.withColumn("bucket", bucket).withColumn("h", F.xxhash64("doc_id")).withColumn("slice", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * slices).cast("bigint"))
    # rows before each slice: windows over slice totals, a few rows for each bucket
    sizes = keyed.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("bucket", "slice", "n", "sum(n) over (partition by bucket order by slice) - n as offset")
    caps = [max(1, budget // max(1, b)) for b in bounds]
    held = {r.bucket: r.n for r in sizes.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    starts, at = [], 0
    for k, cap in enumerate(caps):
        starts.append(at)
        at += -(-held.get(k, 0) // cap)
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("bucket") + 1).cast("bigint")
    ranked = keyed.selectExpr("*", "row_number() over (partition by bucket, slice order by h, doc_id, length) - 1 as place")
    ranked = ranked.join(before.select("bucket", "slice", "offset"), ["bucket", "slice"]).withColumn("rank", F.col("place") + F.col("offset")).withColumn("cap", pick(caps))
    out = ranked.select(
        "doc_id", "length", F.col("bucket").cast("int").alias("bucket"), pick(bounds).alias("bucket_len"),
        (pick(starts) + F.floor(F.col("rank") / F.col("cap"))).cast("bigint").alias("batch_id"), (F.col("rank") % F.col("cap")).cast("bigint").alias("slot"),
        (pick(bounds) - F.col("length")).alias("padding"),
    )
    return settle(out, rows)
