"""N-gram Jaccard self-join by multiple-global-order filtering.

Each document is the set of its distinct n-word shingles. For a threshold t, a
set of size m has, in any global order of the tokens, a prefix of
m - ceil(t m) + 1 tokens that shares a token with the same prefix of every
partner. Several orders give several such filters; a pair must pass all.

Plan:

1. One scan gives each document its size, the hash of its set (equal sets are one
   *class* from here on, so copies cost nothing further), the least token of
   a few hash orders, and a sketch of token frequencies in fixed-size slots.
2. Stars: the classes with one least token are compared with one centre only (the
   one with the fewest rare tokens: edits make rare tokens), a number of pairs linear in
   the documents however large the group. Verified links are merged into components.
3. Order 1 ranks tokens by frequency level, then hash, so what many documents
   share comes last. Prefix tokens held by classes of more than one component
   give pairs; inside a component nothing is left to find out, so a large group of
   near copies makes no pairs among itself.
4. Pairs must share a prefix token under orders 2 (coarse frequency levels) and 3 (a hash
   alone) as well, looked up only for the documents that are in a pair; then whole sets
   are intersected.
5. Components of all links.

No step caps a bucket or a partner list; links between different texts are found
or implied by a path of verified links.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kit import U64, bloom_of, column, components, free_memory, mix, release, run_hash, seg_index, settle, stash, text_slices, tidy, words_of

#: Hash orders whose least token makes stars.
STARS = 6
_RANGES = 64
#: Frequency level of a token three deviations over the mean; what edits make is below it.
_COMMON = 28


def _seed(k: int) -> np.uint64:
    return mix(np.array([k * 7919 + 17], np.uint64))[0]


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending inside a text: (hashes, sizes).

    A text of 1 to n - 1 words has its whole sequence as only shingle; one
    without words has none.
    """
    w, first, _ = words_of(data, offs)
    count = np.diff(first)
    runs = run_hash(w, n)
    sizes = np.zeros(len(count), np.int64)
    out = []
    for i, c in enumerate(count.tolist()):
        if not c:
            continue
        a = first[i]
        if c < n:
            h = mix(run_hash(w[a:a + c], c) + U64(c))
        else:
            h = np.sort(runs[a:a + c - n + 1])
            if len(h) > 1:
                keep = np.empty(len(h), bool)
                keep[0] = True
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                h = h[keep]
        sizes[i] = len(h)
        out.append(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def prefix_len(m: int, num: int, den: int) -> int:
    """m - ceil(t m) + 1 for t = num / den."""
    return m - -(-num * m // den) + 1


class Order:
    """A global token order: frequency level first (rare tokens first; ``coarse``: eight levels are one), then a hash.

    Without levels, by hash alone.
    """

    def __init__(self, k: int, levels: np.ndarray | None, coarse: bool = False):
        self.seed, self.levels = _seed(100 + k), levels >> 3 if coarse and levels is not None else levels

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        h = mix(tokens ^ self.seed)
        if self.levels is None:
            return h
        slot = (tokens >> U64(20)) & U64(len(self.levels) - 1)
        return (self.levels[slot.astype(np.int64)].astype(np.uint64) << U64(58)) | (h >> U64(6))


def prefixes(tokens: np.ndarray, sizes: np.ndarray, order: Order, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending prefix keys of each set end to end, and their number for each set."""
    keys = order.keys(tokens)
    ends = np.cumsum(sizes)
    out, lens = [], np.zeros(len(sizes), np.int64)
    for i in np.flatnonzero(sizes).tolist():
        m = int(sizes[i])
        p = prefix_len(m, num, den)
        own = keys[ends[i] - m:ends[i]]
        own = np.sort(np.partition(own, p - 1)[:p] if p < m else own)
        out.append(own)
        lens[i] = p
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), lens


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _classes(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set (0 for the empty set)."""
    ends = np.cumsum(sizes)
    full = sizes > 0
    starts = (ends - sizes)[full]
    out = []
    for k in (1, 2):
        h = np.zeros(len(sizes), np.uint64)
        if len(starts):
            h[full] = mix(np.add.reduceat(mix(tokens ^ _seed(k)), starts) + sizes[full].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        out.append(h)
    return out[0], out[1]


def _least(tokens: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    full = sizes > 0
    out = np.zeros(len(sizes), np.uint64)
    starts = (np.cumsum(sizes) - sizes)[full]
    if len(starts):
        out[full] = np.minimum.reduceat(mix(tokens ^ _seed(10 + k)), starts)
    return out


def _profile(docs: DataFrame, n: int, slots: int) -> DataFrame:
    """First scan: a row for each document, and each task's share of the sketch."""
    step = slots // _RANGES
    stars = [f"s{k}" for k in range(STARS)]
    form = f"doc_id bigint, m bigint, c1 bigint, c2 bigint, {', '.join(f'{s} bigint' for s in stars)}, r int, blob binary"
    schema = pa.schema([("doc_id", pa.int64()), ("m", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), *((s, pa.int64()) for s in stars), ("r", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, loose, n_loose = np.zeros(slots, np.uint32), [], 0

        def take_in() -> None:
            nonlocal counts, loose, n_loose
            if loose:
                counts += np.bincount(np.concatenate(loose), minlength=slots).astype(np.uint32)
                loose, n_loose = [], 0

        for b in batches:
            for rows, data, offs in text_slices(b, "text"):
                tokens, sizes = shingle_sets(data, offs, n)
                c1, c2 = _classes(tokens, sizes)
                cols = [column(rows, "doc_id"), pa.array(sizes), _signed(c1), _signed(c2), *(_signed(_least(tokens, sizes, k)) for k in range(STARS))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(rows), f.type) for f in list(schema)[-2:])], schema=schema)
                loose.append(((tokens >> U64(20)) & U64(slots - 1)).astype(np.int32))
                n_loose += len(tokens)
                if n_loose * 4 > slots:
                    take_in()
        take_in()
        # deflated: a task that saw little text sends little, one that saw much a few bits a slot
        parts = [(r, own) for r in range(_RANGES) if (own := counts[r * step:(r + 1) * step]).any()]
        if parts:
            k = len(parts)
            blobs = [zlib.compress(own.astype(np.uint8 if own.max() < 256 else np.uint32).tobytes(), 1) for _, own in parts]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, f.type) for f in list(schema)[:-2]), pa.array([r for r, _ in parts], pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    return docs.mapInArrow(tidy(run), form)


def _sketch_levels(parts: DataFrame, slots: int) -> np.ndarray:
    """Frequency level (0 to 63) of each slot: quarters of a deviation about the mean, then half-powers of two beyond six.

    Summed on the executors in 64 ranges, two levels deep; the driver gets one
    byte a slot, whatever the corpus.
    """
    step = slots // _RANGES

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for blob in t.column("blob"):
            raw = zlib.decompress(blob.as_buffer())
            total += np.frombuffer(raw, {step: np.uint8, 4 * step: np.uint32, 8 * step: np.int64}[len(raw)])
        return pa.table({"r": t.column("r")[:1], "salt": t.column("salt")[:1].cast(pa.int32()), "blob": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    form = "r int, salt int, blob binary"
    parts = parts.select("r", (F.spark_partition_id() % 32).alias("salt"), "blob")
    sums = parts.groupBy("r", "salt").applyInArrow(add, form).groupBy("r").applyInArrow(add, form)

    def level(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in column(b, "blob"):
                c = np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)
                z = (c - mean) / mean**0.5
                far = 40 + np.minimum(23, np.floor(2 * np.log2(np.maximum(z, 6) / 6)))
                out.append(np.where(z < 6, np.clip(np.floor(4 * (z + 4)), 0, 39), far).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([column(b, "r"), pa.array(out, pa.binary())], ["r", "blob"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(zlib.decompress(x.as_buffer()), np.int64).sum()) for x in column(b, "blob")], pa.int64())], ["n"])

    kept = stash(sums.select("r", "blob"))
    mean = max(1.0, (kept.mapInArrow(tidy(total), "n bigint").agg(F.sum("n")).first()[0] or 0) / slots)
    levels = np.zeros(slots, np.uint8)
    for row in kept.mapInArrow(lambda bs: level(bs, mean), "r int, blob binary").collect():
        levels[row.r * step:(row.r + 1) * step] = np.frombuffer(row.blob, np.uint8)
    release(kept)
    return levels


def _index(docs: DataFrame, n: int, order, num: int, den: int, only=None) -> DataFrame:
    """Prefix tokens of every document: (token, cls, pos, m), pos from 1; ``only``: a Bloom filter of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, sieve = order.value, only.value if only is not None else None
        for b in batches:
            for _, data, offs in text_slices(b, "text"):
                tokens, sizes = shingle_sets(data, offs, n)
                c1, _ = _classes(tokens, sizes)
                keys, lens = prefixes(tokens, sizes, o, num, den)
                cls, pos, m = np.repeat(c1, lens), seg_index(lens) + 1, np.repeat(sizes, lens)
                if sieve is not None:
                    k = sieve.hit(keys)
                    yield pa.RecordBatch.from_arrays([_signed(keys[k]), _signed(cls[k]), pa.array(pos[k]), pa.array(m[k])], ["token", "cls", "pos", "m"])
                else:
                    yield pa.RecordBatch.from_arrays([_signed(keys), _signed(cls)], ["token", "cls"])

    return docs.select("text").mapInArrow(tidy(run), "token bigint, cls bigint" + ("" if only is None else ", pos bigint, m bigint"))


def _fetch(docs: DataFrame, n: int, wanted, payload: Callable) -> DataFrame:
    """(cls, blob) of the documents whose doc_id passes the Bloom filter or is null, one row for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = wanted.value
        for b in batches:
            ids = column(b, "doc_id")
            # a class of null ids only has no representative in the filter
            hit = sieve.hit(ids.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)) | ids.is_null().to_numpy(zero_copy_only=False)
            b = b.take(pa.array(np.flatnonzero(hit)))
            seen: set[int] = set()
            for _, data, offs in text_slices(b, "text"):
                tokens, sizes = shingle_sets(data, offs, n)
                cls = _classes(tokens, sizes)[0].view(np.int64)
                blobs = payload(tokens, sizes)
                new = [i for i, c in enumerate(cls.tolist()) if not (c in seen or seen.add(c))]
                yield pa.RecordBatch.from_arrays([pa.array(cls[new]), pa.array([blobs[i] for i in new], pa.binary())], ["cls", "blob"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "cls bigint, blob binary").dropDuplicates(["cls"])


def _bytes_of(x: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [x[e - m:e].tobytes() for e, m in zip(ends, sizes.tolist(), strict=True)]


def _judge(pairs: DataFrame, blobs: DataFrame, test: Callable) -> DataFrame:
    """The pairs (a, b) whose blobs (a stashed table) pass ``test``; b's side is the hub of stars and joined last."""
    half = pairs.join(blobs.select(F.col("cls").alias("a"), F.col("blob").alias("x")), "a")
    both = half.join(blobs.select(F.col("cls").alias("b"), F.col("blob").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            xs, ys = column(t, "x"), column(t, "y")
            good = [i for i in range(len(t)) if test(xs[i].as_buffer(), ys[i].as_buffer())]
            t = t.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([column(t, "a"), column(t, "b")], ["a", "b"])

    return both.mapInArrow(tidy(run), "a bigint, b bigint")


def _rare_counts(order) -> Callable:
    """Payload for ``_fetch``: the number of tokens of usual frequency, four bytes, highest first."""

    def payload(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        low = order.value.levels[((tokens >> U64(20)) & U64(len(order.value.levels) - 1)).astype(np.int64)] < _COMMON
        sums = np.concatenate(([0], np.cumsum(low)))
        ends = np.cumsum(sizes)
        return [int(x).to_bytes(4, "big") for x in sums[ends] - sums[ends - sizes]]

    return payload


def _filter_test(x, y) -> bool:
    """Do the blobs (32-bit prefix keys of each order, lengths first) share a token in every order?"""
    x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    k = int(x[0])
    ax, ay = 1 + k, 1 + k
    for o in range(k):
        nx, ny = int(x[1 + o]), int(y[1 + o])
        if not len(np.intersect1d(x[ax:ax + nx], y[ay:ay + ny])):
            return False
        ax, ay = ax + nx, ay + ny
    return True


def _verify_test(num: int, den: int) -> Callable:
    def test(x, y) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if den * min(len(x), len(y)) < num * max(len(x), len(y)):
            return False
        both = np.concatenate((x, y))
        both.sort()
        inter = int((both[1:] == both[:-1]).sum())
        return den * inter >= num * (len(both) - inter)

    return test


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: str = "0.8", slots: int | None = None) -> DataFrame:
    """Group documents linked by Jaccard similarity of n-word shingles >= threshold.

    Returns one row per input row: doc_id, n_shingles (set size), component_id
    (least doc_id reachable by links, itself included). Null, empty and
    word-less texts have size 0 and are linked with nothing; equal texts share a
    component; repeated rows give repeated rows; a null id keeps its row (its
    component is the least non-null id in it, or null). Other columns are
    ignored. An empty table gives an empty result.

    ``slots`` (a power of two, 2^20 to 2^26 by the number of rows) is the size of
    the frequency sketch in bytes; it orders tokens and never changes a result.
    """
    spark = docs.sparkSession
    t = Fraction(threshold)
    num, den = t.numerator, t.denominator
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if slots is None:
        slots = 1 << min(26, max(20, (docs.count() * 16).bit_length()))
    share = spark.sparkContext.broadcast

    scan = stash(_profile(docs, n, slots))
    rows = scan.where("r is null")
    levels = _sketch_levels(scan.where("r is not null"), slots)
    stars = [f"s{k}" for k in range(STARS)]
    firsts = [F.first(s).alias(s) for s in stars]
    classes = stash(rows.where("m > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("m").alias("m"), *firsts).select(F.col("c1").alias("cls"), "c2", "rep", "copies", "m", *stars))

    # 2. stars: one centre for each least token, the class with the fewest rare tokens (an original
    # has none of the tokens that edits made), then with most copies
    every = classes.select("cls", "m", "copies", F.posexplode(F.array(*stars)).alias("k", "least"))
    # aggregates are written before a join on their key: AQE splits a hot key only between bare shuffles
    shared = stash(every.groupBy("k", "least").agg(F.count("*").alias("size")).where("size > 1").select("k", "least"))
    members = stash(every.join(shared, ["k", "least"]))
    release(shared)
    wanted = share(bloom_of(members.select("cls").distinct().join(classes.select("cls", "rep"), "cls"), "rep"))
    rare = _fetch(docs, n, wanted, _rare_counts(share(Order(0, levels)))).select("cls", F.conv(F.hex("blob"), 16, 10).cast("bigint").alias("rare"))
    marked = stash(members.join(rare, "cls", "left"))
    release(members)
    members = marked
    centre = stash(members.groupBy("k", "least").agg(F.min(F.struct("rare", F.negative("copies").alias("fewer"), "cls", "m")).alias("c")).select("k", "least", F.col("c.cls").alias("b"), F.col("c.m").alias("mb")))
    close = f"least(m, mb) * {den} >= greatest(m, mb) * {num}"
    pairs = members.join(centre, ["k", "least"]).where(f"cls <> b and {close}").select(F.col("cls").alias("a"), "b").distinct()
    links, used = _confirm(docs, classes, stash(pairs), n, num, den, levels)
    first = components(links)

    # 3. prefix tokens held by more than one class, then by more than one component
    order = share(Order(1, levels))
    held = _index(docs, n, order, num, den).groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("token")
    held = stash(held)
    # 16 bits a token, 16 MB at most; more tokens than that only let more rows through
    sieve = share(bloom_of(held, "token", 1 << min(27, max(20, (held.count() * 16).bit_length()))))
    index = _index(docs, n, order, num, den, sieve).distinct()
    index = index.join(first.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    index = stash(index)
    # each token's major component: pairs need a member outside it
    by_comp = index.groupBy("token", "comp").agg(F.count("*").alias("size"))
    major = by_comp.groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("size", "comp")).alias("top")).where("comps > 1").select("token", F.col("top.comp").alias("major"))
    major = stash(major)
    live = stash(index.join(major, "token"))
    minor = live.where("comp <> major").select("token", F.col("cls").alias("a"), F.col("comp").alias("ca"), F.col("pos").alias("pa"), F.col("m").alias("ma"))
    other = live.select("token", F.col("cls").alias("b"), F.col("comp").alias("cb"), "major", F.col("pos").alias("pb"), F.col("m").alias("mb"))
    # sizes fit, and what can follow the shared token reaches the overlap needed
    need = (F.col("ma") * den >= F.col("mb") * num) & (F.col("mb") * den >= F.col("ma") * num) & ((F.lit(1) + F.least(F.col("ma") - F.col("pa"), F.col("mb") - F.col("pb"))) * (num + den) >= (F.col("ma") + F.col("mb")) * num)
    once = (F.col("cb") == F.col("major")) | (F.col("a") < F.col("b"))
    pairs = minor.join(other, "token").where((F.col("ca") != F.col("cb")) & once & need).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more, used2 = _confirm(docs, classes, stash(pairs), n, num, den, levels)

    # 5. components of all links, by least doc_id
    whole = components(links.union(more))
    named = classes.select("cls", "c2", "rep").join(whole.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = stash(named.groupBy("comp").agg(F.min("rep").alias("component_id")))
    ids = named.join(least, "comp").select(F.col("cls").alias("c1"), "c2", "component_id")
    out = rows.select("doc_id", "m", "c1", "c2").join(ids, ["c1", "c2"], "left").select("doc_id", F.col("m").alias("n_shingles"), F.when(F.col("m") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    free_memory()
    release(members, centre, held, index, major, live, first, links, more, *used, *used2)
    return settle(out, scan, classes, whole, least)


def _confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, num: int, den: int, levels: np.ndarray) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of classes that share prefix tokens in all further orders and whose sets are similar."""
    share = docs.sparkSession.sparkContext.broadcast
    # one order by coarse levels, one by the hash alone: what is rare in one is not first in the other
    orders = share([Order(2, levels, coarse=True), Order(3, None)])

    def filters(tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        each = [prefixes(tokens, sizes, o, num, den) for o in orders.value]
        cols = [_bytes_of((k & U64(0xFFFFFFFF)).astype(np.uint32), lens) for k, lens in each]
        heads = [np.array([len(each), *(int(lens[i]) for _, lens in each)], np.uint32).tobytes() for i in range(len(sizes))]
        return [h + b"".join(c[i] for c in cols) for i, h in enumerate(heads)]

    def wanted(p: DataFrame):
        nodes = p.select(F.col("a").alias("cls")).union(p.select(F.col("b").alias("cls"))).distinct()
        return share(bloom_of(nodes.join(classes.select("cls", "rep"), "cls"), "rep"))

    blobs = stash(_fetch(docs, n, wanted(pairs), filters))
    passed = stash(_judge(pairs, blobs, _filter_test))
    release(pairs, blobs)
    blobs = stash(_fetch(docs, n, wanted(passed), _bytes_of))
    links = stash(_judge(passed, blobs, _verify_test(num, den)).distinct())
    release(blobs)
    return links, [passed]
