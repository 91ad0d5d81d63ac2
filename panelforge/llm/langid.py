"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of the byte n-grams of its training text. The filters
are bit-sliced: an array of words in which bit l of a word belongs to language
l (and one more array for each further 64 languages), so that k look-ups and an AND give the set of all languages that contain an
n-gram. Set bits are counted for each language over a text, the count is corrected
for the filter's rate of false positives, and the largest corrected count decides.
N-grams of N bytes decide where a language has any of a text's; else the text is taken
with a blank on either side and ever shorter n-grams are tried, in filters of their own.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import _BASE, _LOWER_TABLE, U64, column, mix, text_slices, tidy

#: Fit bounds: about so many training documents of a language, of at most so many bytes each
#: (longer ones are not drawn, unless a language has no other). Languages of one filter word.
DOCS, MOST_BYTES, LANGUAGES = 1500, 100_000, 64
N = 6
HASHES = 3
#: Bits of a language's filter (as a power of two) for n-grams of N bytes and for shorter ones.
BITS, SHORT_BITS = 22, 20
#: An n-gram is a language's own if so many of its training documents hold it; a shorter one, a twentieth of them.
LEAST_DOCS = 2
#: N-grams that a task counts before it merges them.
_MERGE = 1 << 21


def grams(data: np.ndarray, n: int = N) -> np.ndarray:
    """Hash of the n bytes (A-Z lower-cased) from each place on; n - 1 fewer than bytes."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    v = _LOWER_TABLE[data]
    h = v[:m].copy()
    for i in range(1, n):
        h *= U64(_BASE)
        h += v[i:i + m]
    return mix(h)


def _places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((h >> U64(k * 20)) & U64((1 << bits) - 1)).astype(np.int64)


class Filters:
    """Bit-sliced Bloom filters; beyond 64 languages, ``words`` and masks have a second axis, a column for each 64."""

    def __init__(self, languages: list[str], bits: int = BITS):
        self.languages, self.bits = languages, bits
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(LANGUAGES, max(1, len(languages))))
        self.words = np.zeros(1 << bits if len(languages) <= LANGUAGES else (1 << bits, -(-len(languages) // LANGUAGES)), kind)
        self.rates = np.zeros(len(languages))

    def add(self, language: int, h: np.ndarray) -> None:
        for p in _places(h, self.bits):
            self.mark(language, p)

    def mark(self, language: int, places: np.ndarray) -> None:
        self._of(self.words, language)[places] |= self.words.dtype.type(1 << language % LANGUAGES)

    @staticmethod
    def _of(masks: np.ndarray, language: int) -> np.ndarray:
        """The words that hold a language's bit."""
        return masks if masks.ndim == 1 else masks[:, language // LANGUAGES]

    def _bits(self, masks: np.ndarray, language: int) -> np.ndarray:
        kind = masks.dtype.type
        return (self._of(masks, language) >> kind(language % LANGUAGES)) & kind(1)

    def close(self) -> None:
        """False positive rate of each language from its share of set bits."""
        for k in range(len(self.languages)):
            self.rates[k] = float(self._bits(self.words, k).mean()) ** HASHES

    def masks(self, h: np.ndarray) -> np.ndarray:
        """All languages of each n-gram, one bit each."""
        first, *rest = _places(h, self.bits)
        out = self.words[first]
        for p in rest:
            out &= self.words[p]
        return out

    def counts(self, masks: np.ndarray, first: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Corrected counts (texts x languages) for runs of n-grams starting at ``first``."""
        out = np.zeros((len(first), len(self.languages)))
        some = total > 0
        for k in range(len(self.languages)):
            bits = self._bits(masks, k).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(bits)))
            hits = sums[first[some] + total[some]] - sums[first[some]]
            out[some, k] = np.maximum(0, (hits - self.rates[k] * total[some]) / max(1e-9, 1 - self.rates[k]))
        return out


class Detector:
    """Filters of N-grams and of shorter ones; ``usual`` is the most frequent language, for texts that no filter knows."""

    def __init__(self, languages: list[str], usual: int = 0):
        self.languages, self.usual = languages, usual
        self.main, self.short = Filters(languages), Filters(languages, SHORT_BITS)

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Corrected counts (texts x languages) of the n-grams of N bytes of each text."""
        h = grams(data)
        total = np.maximum(np.diff(offs) - N + 1, 0)
        return self.main.counts(self.main.masks(h) if len(h) else self.main.words[:0], np.minimum(offs[:-1], len(h)), total)

    def short_counts(self, text: bytes) -> np.ndarray:
        """Counts of the longest n-grams of a text, blanks around it, that any language has; else zeros."""
        data = np.frombuffer(b" " + text + b" ", np.uint8)
        for n in range(N, 0, -1):
            h, f = grams(data if n > 1 else data[1:-1], n), self.main if n == N else self.short
            if len(h):
                found = f.counts(f.masks(h), np.zeros(1, np.int64), np.array([len(h)]))[0]
                if found.max() > 0.5:
                    return found
        return np.zeros(len(self.languages))


def _learned(sample: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(k, kind, blob): the filter of each language, kind 0 for n-grams of N bytes, 1 for shorter ones; sample: (k, text).

    Each task counts the documents that hold an n-gram; counts meet in 16 ranges of a
    language's n-grams, and what is left of a range is its bits.
    """
    form = "k int, kind int, part int, grams binary, counts binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def merge(key) -> None:
            values, n = (np.concatenate(x) for x in zip(*held[key], strict=True))
            values, place = np.unique(values, return_inverse=True)
            held[key] = [(values, np.bincount(place, n).astype(np.int64))]

        for b in batches:
            for k, text in zip(column(b, "k").to_pylist(), column(b, "text").to_pylist(), strict=True):
                data = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
                for kind, own in ((0, [grams(data)]), (1, [grams(data, n) for n in range(1, N)])):
                    own = np.unique(np.concatenate(own))
                    parts = held.setdefault((k, kind), [])
                    parts.append((own, np.ones(len(own), np.int64)))
                    if len(parts) > 1 and sum(len(v) for v, _ in parts[1:]) > max(_MERGE, len(parts[0][0])):
                        merge((k, kind))
        for key in held:
            merge(key)
            values, n = held[key][0]
            cuts = np.searchsorted(values, np.arange(16, dtype=np.uint64) << U64(60))
            ends = np.append(cuts[1:], len(values))
            rows = [(part, values[x:y].tobytes(), n[x:y].tobytes()) for part, (x, y) in enumerate(zip(cuts, ends, strict=True)) if y > x]
            if rows:
                m = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * m, pa.int32()), pa.array([key[1]] * m, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["k", "kind", "part", "grams", "counts"])

    def one(t: pa.Table, blob: bytes) -> pa.Table:
        return pa.table({"k": t.column("k")[:1], "kind": t.column("kind")[:1], "blob": pa.array([blob], pa.binary())})

    def keep(t: pa.Table) -> pa.Table:
        kind, docs = t.column("kind")[0].as_py(), sizes[t.column("k")[0].as_py()]
        values, place = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("grams")]), return_inverse=True)
        n = np.bincount(place, np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts")]))
        least = max(min(LEAST_DOCS, docs), min(docs, DOCS) // 20 if kind else 0)
        bits = np.zeros(1 << (SHORT_BITS if kind else BITS), bool)
        for p in _places(values[n >= least], SHORT_BITS if kind else BITS):
            bits[p] = True
        return one(t, zlib.compress(np.packbits(bits).tobytes(), 1))

    def unite(t: pa.Table) -> pa.Table:
        whole = None
        for x in t.column("blob"):
            bits = np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8)
            whole = bits if whole is None else whole | bits
        return one(t, zlib.compress(whole.tobytes(), 1))

    counted = sample.mapInArrow(tidy(learn), form)
    return counted.groupBy("k", "kind", "part").applyInArrow(keep, "k int, kind int, blob binary").groupBy("k", "kind").applyInArrow(unite, "k int, kind int, blob binary")


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: Column | None = None) -> Detector:
    """Fit on a bounded sample: about DOCS whole documents of each language, by hash of the id.

    Every language is learned; each LANGUAGES of them take a scan. The n-grams are counted
    on the executors; the driver gets the filters, at most 640 KB a language. ``train`` (on
    the columns doc_id and lang) admits rows. Null texts, langs and ids are left out;
    documents over MOST_BYTES are not drawn unless a language has no other. Repeated rows count
    each. An empty table teaches nothing.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where("text is not null and lang is not null and doc_id is not null")
    own = own.where(train) if train is not None else own
    fits = F.octet_length("text") <= MOST_BYTES
    sizes = {r.lang: r for r in own.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(fits).alias("fit"), F.min(F.octet_length("text")).alias("least")).collect()}
    if not sizes:
        return Detector([])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    names = sorted(sizes)
    out = Detector(names, min(range(len(names)), key=lambda k: (-sizes[names[k]].n, k)))
    for at in range(0, len(names), LANGUAGES):
        some = names[at:at + LANGUAGES]
        number = {lang: k for k, lang in enumerate(some, at)}
        drawn = {lang: sizes[lang].fit or 1 for lang in some}
        pick = lambda value: F.coalesce(*(F.when(F.col("lang") == lang, F.lit(value(lang))) for lang in some))  # noqa: B023, E731
        chosen = (h < pick(lambda x: int(1_000_000 * min(1.0, DOCS / drawn[x])))) & (F.octet_length("text") <= pick(lambda x: max(MOST_BYTES, sizes[x].least)))  # noqa: B023
        sample = own.where(chosen).select(pick(number.get).cast("int").alias("k"), "text")
        for r in _learned(sample, {number[x]: drawn[x] for x in some}).collect():
            bits = np.unpackbits(np.frombuffer(zlib.decompress(r.blob), np.uint8)).astype(bool)
            (out.short if r.kind else out.main).mark(r.k, np.flatnonzero(bits))
    out.main.close()
    out.short.close()
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def detect_languages(docs: DataFrame, filters: Detector, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1: the winner's share of all corrected counts) of each whole text.

    `und` with score 0 if the text is null or has no letter, or nothing was learned.
    A text with letters but no n-gram of any length that a language has gets the most
    frequent language, with score 0; ties go to the first language by name. Rows keep
    their number; null ids and repeated rows stay; other columns are ignored; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            for rows, data, offs in text_slices(b, "text"):
                n = len(rows)
                letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
                known = letters[offs[1:]] > letters[offs[:-1]]
                for i in np.flatnonzero(~known & (np.diff(offs) > 0)):
                    known[i] = has_letter(bytes(data[offs[i]:offs[i + 1]]).decode())
                if f.languages:
                    counts = f.counts(data, offs)
                    for i in np.flatnonzero(known & (counts.max(axis=1) <= 0.5)):
                        counts[i] = f.short_counts(bytes(data[offs[i]:offs[i + 1]]))
                    whole = counts.sum(axis=1)
                    best = np.where(whole > 0, counts.argmax(axis=1), f.usual)
                    score = np.where(known & (whole > 0), counts[np.arange(n), best] / np.where(whole > 0, whole, 1), 0.0)
                else:
                    best, score, known = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                names = [f.languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id bigint, lang_pred string, score double")
