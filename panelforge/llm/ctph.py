"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the UTF-8 text; where its low bits are
all ones a chunk ends, so that boundaries follow the content and an edit moves
only those near it. Each chunk gives one of 64 characters. The block size is the
least power of two with at most 64 chunks; the fingerprint holds the signatures at that
size, twice and four times it, so texts whose sizes differ by a factor of four still compare.
Likeness is 1 - edit distance / longer length, the best over the sizes both have.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import _TABLE, U64, column, prefix_hash, span_hash, text_slices, tidy

WINDOW = 7
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MOST = 64
#: Block sizes of a fingerprint, each twice the one before.
SIZES = 3
Print = tuple  # (log2 of the least block size, a signature for each size)
_SMALL = (_TABLE >> U64(32)).astype(np.uint32)
_STEP = np.uint32(0x01000193)
_MOST_BITS = 30


def trailing_ones(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Trailing one bits of the rolling hash at each byte; windows don't reach over text starts."""
    n = len(data)
    lens = np.diff(offs)
    place = np.arange(n) + np.repeat(np.arange(1, len(lens) + 1) * WINDOW, lens)
    wide = np.zeros(n + (len(lens) + 1) * WINDOW, np.uint32)
    wide[place] = _SMALL[data]
    h = np.zeros(len(wide), np.uint32)
    for k in range(WINDOW - 1, -1, -1):
        h *= _STEP
        h[k:] += wide[:len(wide) - k] if k else wide
    h = h[place]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    low = ~h
    low &= ~low + np.uint32(1)
    out = np.full(n, _MOST_BITS, np.uint8)
    some = low > 0
    out[some] = np.minimum(np.log2(low[some].astype(np.float64)), _MOST_BITS).astype(np.uint8)
    return out


def signatures(data: np.ndarray, offs: np.ndarray) -> list[Print]:
    """For each text (log2 of block size, signatures at that size, twice and four times it), as places in LETTERS."""
    out: list[Print] = []
    none = np.zeros(0, np.uint8)
    if not len(data):
        return [(0, none, none, none)] * (len(offs) - 1)
    ones = trailing_ones(data, offs)
    prefix = prefix_hash(data, _TABLE)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if a == b:
            out.append((0, none, none, none))
            continue
        own = ones[a:b]
        # boundaries at 2^j are those at 2^(j+1) and others: count once, from the top
        least = np.cumsum(np.bincount(own, minlength=_MOST_BITS + 1)[::-1])[::-1]
        level = int(np.argmax(least < MOST)) if (least < MOST).any() else _MOST_BITS + 1
        each = []
        for j in range(level, level + SIZES):
            end = np.flatnonzero(own >= j) + a + 1
            if not len(end) or end[-1] != b:
                end = np.append(end, b)
            start = np.concatenate(([a], end[:-1]))
            each.append((span_hash(prefix, start, end) >> U64(58)).astype(np.uint8))
        out.append((level, *each))
    return out


def written(fp: Print) -> str:
    return ":".join([str(1 << fp[0]), *("".join(LETTERS[i] for i in x) for x in fp[1:])])


def read_back(text: str) -> Print:
    size, *each = text.split(":")
    place = {c: i for i, c in enumerate(LETTERS)}
    return int(size).bit_length() - 1, *(np.array([place[c] for c in x], np.uint8) for x in each)


def edit_distances(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Levenshtein distances of many pairs of strings of at most 64 letters, bit-parallel over all pairs."""
    k = len(left)
    m = np.array([len(x) for x in left], np.int64)
    n = np.array([len(x) for x in right], np.int64)
    row = np.arange(k)
    where = np.zeros((k, MOST + 1), np.uint64)
    flat_row, flat_at = np.repeat(row, m), np.concatenate([np.arange(x) for x in m]) if k else np.zeros(0, np.int64)
    letters = np.concatenate(left).astype(np.int64) if m.sum() else np.zeros(0, np.int64)
    np.bitwise_or.at(where, (flat_row, letters), U64(1) << flat_at.astype(np.uint64))
    text = np.full((int(n.max(initial=0)), k), MOST, np.int64)
    if n.sum():
        text[np.concatenate([np.arange(x) for x in n]), np.repeat(row, n)] = np.concatenate(right)
    pv, mv = np.full(k, ~U64(0)), np.zeros(k, np.uint64)
    top = np.maximum(m - 1, 0).astype(np.uint64)
    score = m.copy()
    for j in range(len(text)):
        eq = where[row, text[j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        live = j < n
        score += live * (((ph >> top) & U64(1)).astype(np.int64) - ((mh >> top) & U64(1)).astype(np.int64))
        ph = (ph << U64(1)) | U64(1)
        mh = mh << U64(1)
        pv = mh | ~(xv | ph)
        mv = ph & xv
    return np.where(m == 0, n, score)


def likeness(a: list[Print], b: list[Print]) -> np.ndarray:
    """Likeness (0 to 1) of pairs of fingerprints at all block sizes both have, the best of them; 0 where none is shared, 1 for equal ones."""
    owner, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        for size in range(max(x[0], y[0]), min(x[0], y[0]) + SIZES):
            owner.append(i)
            left.append(x[1 + size - x[0]])
            right.append(y[1 + size - y[0]])
    out = np.zeros(len(a))
    if owner:
        longer = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)])
        np.maximum.at(out, owner, np.where(longer == 0, 1.0, 1 - edit_distances(left, right) / np.maximum(longer, 1)))
    return out


def fingerprints_of(texts: list[str]) -> list[Print]:
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
    return signatures(np.frombuffer(b"".join(raw), np.uint8), offs)


def ctph_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each whole text.

    A null text is empty and has empty signatures; a very long one is hashed whole, at larger
    block sizes. Equal texts have equal fingerprints. Rows keep their number; null ids and
    repeated rows stay; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, offs in text_slices(b, "text"):
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array([written(s) for s in signatures(data, offs)])], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into ascending id ranges, sorted, each range followed by the first row of the next.

    Columns doc_id, text, bucket, follows (true for that extra row). The ranges come
    from approximate percentiles of the ids; only their bounds and least ids, one for each
    partition, reach the driver. A row finds its range in two steps over about the
    square root of their number. The last range is followed by the first row.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions(), 1)
    found = docs.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10 * n + 1000).alias("bounds"), F.max("k").alias("top")).first()
    # each bound is an id, and there is one beyond the last: no range is empty
    bounds = sorted({b for b in found.bounds or [] if b < found.top})
    bucket = _range_of(key, bounds)
    keyed = docs.withColumn("k", key).withColumn("bucket", bucket)
    heads = [r.k for r in keyed.groupBy("bucket").agg(F.min("k").alias("k")).collect()]
    # the first rows of a range also go to the range before it
    count = len(bounds) + 1
    place = lambda b, follows: F.struct(b.cast("int").alias("b"), F.lit(follows).alias("f"))
    own = place(F.col("bucket"), False)
    places = F.when(F.col("k").isin(heads), F.array(own, place(F.pmod(F.col("bucket") - 1, F.lit(count)), True))).otherwise(F.array(own))
    dealt = keyed.select("doc_id", "k", "text", F.explode(places).alias("p")).select("doc_id", "k", "text", F.col("p.b").alias("bucket"), F.col("p.f").alias("follows"))
    return dealt.repartitionById(count, F.col("bucket")).sortWithinPartitions("bucket", "follows", "k", "text").drop("k")


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` (ascending) below the key: which run of them, then which place in the run."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    runs = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x < key))
    run = below(F.lit([r[-1] for r in runs]))
    inside = below(F.element_at(F.lit([*runs, []]), run + 1))
    # beyond the last bound, a short last run counts as it is long
    return F.least(run * step + inside, F.lit(len(bounds))).cast("int")


def ctph_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and likenesses.

    Edited: the last floor(n / 4) of n code points replaced by the first as many
    (or all) of the next text by ascending doc_id (the last is followed by the
    first). Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty; null ids come first; rows with
    one id follow each other by text, and each is a row of the result. A single row
    is its own next. An empty table gives an empty result.
    """
    form = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, until its next is known: (id, text, bucket, follows)
        for b in batches:
            for rows, _, _ in text_slices(b, "text"):
                part = list(zip(*(column(rows, c).to_pylist() for c in ("doc_id", "text", "bucket", "follows")), strict=True))
                part = part if held is None else [held, *part]
                held = part[-1]
                texts = [p[1] for p in part]
                fps = fingerprints_of(texts)
                own = [i for i in range(len(part) - 1) if not part[i][3] and part[i][2] == part[i + 1][2]]
                if not own:
                    continue
                edited = []
                for i in own:
                    q = len(texts[i]) // 4
                    edited.append(texts[i][:len(texts[i]) - q] + texts[i + 1][:q])
                efps = fingerprints_of(edited)
                mine, after = [fps[i] for i in own], [fps[i + 1] for i in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part[i][0] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([written(f) for f in mine]), pa.array([written(f) for f in efps]),
                        pa.array(likeness(mine, efps)), pa.array(likeness(mine, after)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_next(docs, id_col, text_col).mapInArrow(tidy(run), form)
