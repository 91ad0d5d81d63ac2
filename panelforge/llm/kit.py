"""Shared building blocks: numpy text hashing over Arrow batches, Bloom filters of fixed size."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import components, release, settle, stash  # noqa: F401

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 18

U64 = np.uint64
_MIX = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB))


# --- Arrow helpers -----------------------------------------------------------

def text_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about ``limit`` bytes of text.

    Yields (rows, bytes, offsets): UTF-8 bytes of all texts end to end, and the
    n + 1 starts. Null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(column))
    col = col.fill_null("") if col.null_count else col
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] and offs[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), data[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
        at = end


def tidy(run: Callable) -> Callable:
    """Wrap a batch function: when its task ends, give freed memory back to the system.

    Python workers are reused and share the executor's memory with the JVM; what
    one stage freed should not count against the next.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return wrapped


def free_memory() -> None:
    """Give memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


# --- hashing -------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, a new array."""
    x = x + _MIX[0]
    x ^= x >> U64(30)
    x *= _MIX[1]
    x ^= x >> U64(27)
    x *= _MIX[2]
    x ^= x >> U64(31)
    return x


_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = mix(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Running polynomial sums (wrapping 64 bits) for ``span_hash``."""
    power, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal spans have equal hashes wherever they stand."""
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: (hashes, first word of each text, byte starts).

    The second array has n + 1 entries: the words of text i are [f[i], f[i+1]).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    head[cuts] = inside[cuts]
    tail[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    h = span_hash(prefix_hash(data, _LOWER_TABLE if lower else _TABLE), start, end)
    return h, np.searchsorted(start, offs), start


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (length len(words) - k + 1)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    m = len(words) - k + 1
    out = words[:m].copy()
    for i in range(1, k):
        out *= U64(_BASE)
        out += words[i:i + m]
    return mix(out)


def seg_index(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each segment, end to end."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


# --- Bloom filter of fixed size ----------------------------------------------------

class Bloom:
    """Bloom filter of 64-bit keys in ``bits`` bits (a power of two).

    Its size is a parameter, not a function of the data: more keys than it is
    made for raise the share of false hits, never lose a key, and every user
    joins exactly afterwards.
    """

    def __init__(self, bits: int, hashes: int = 4, words: np.ndarray | None = None):
        self.bits, self.hashes = bits, hashes
        self.array = np.zeros(bits >> 3, np.uint8) if words is None else words

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a = mix(keys.astype(np.uint64, copy=False))
        b = mix(a) | U64(1)
        for i in range(self.hashes):
            yield (a + U64(i) * b) & U64(self.bits - 1)

    def add(self, keys: np.ndarray) -> None:
        for p in self._places(keys):
            np.bitwise_or.at(self.array, (p >> U64(3)).astype(np.int64), (U64(1) << (p & U64(7))).astype(np.uint8))

    def hit(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in self._places(keys):
            out &= (self.array[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom_of(df: DataFrame, key: str, bits: int = 1 << 24) -> Bloom:
    """Bloom filter of a bigint column, OR-ed on the executors in 64 ranges.

    The driver gets bits / 8 bytes (2 MB by default) whatever the size of ``df``.
    """
    ranges = 64
    step = bits // 8 // ranges

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, any_key = Bloom(bits), False
        for b in batches:
            keys = column(b, key).drop_null().to_numpy(zero_copy_only=False)
            if len(keys):
                mine.add(keys.astype(np.int64).view(np.uint64))
                any_key = True
        if any_key:
            parts = [(r, mine.array[r * step:(r + 1) * step]) for r in range(ranges)]
            parts = [(r, x.tobytes()) for r, x in parts if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["r", "blob"])

    def merge(blobs: pa.Table) -> pa.Table:
        total = np.zeros(step, np.uint8)
        for x in blobs.column("blob"):
            total |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"r": blobs.column("r")[:1], "salt": blobs.column("salt")[:1].cast(pa.int32()), "blob": pa.array([total.tobytes()], pa.binary())})

    # two levels, so that no task holds the blobs of very many tasks
    form = "r int, salt int, blob binary"
    parts = df.select(key).mapInArrow(tidy(build), "r int, blob binary").withColumn("salt", F.spark_partition_id() % 64)
    parts = parts.groupBy("r", "salt").applyInArrow(merge, form).groupBy("r").applyInArrow(merge, form)
    whole = np.zeros(bits >> 3, np.uint8)
    for row in parts.select("r", "blob").collect():
        whole[row.r * step:(row.r + 1) * step] = np.frombuffer(row.blob, np.uint8)
    free_memory()
    return Bloom(bits, words=whole)
