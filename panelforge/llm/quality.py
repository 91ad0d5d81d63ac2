"""Quality classifier by compression: zstandard dictionaries of good and bad text.

A text is compressed with either dictionary; the difference of the two sizes,
normalised by their sum and by the length, is calibrated to a probability by
logistic regression together with the size and ratio it was measured at. Only
the text enters a score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kit import column, text_slices, tidy

#: Fit bounds: labelled documents of each class whose whole texts are its dictionary, the longest
#: text drawn for one (bytes; longer ones only calibrate), and labelled documents to calibrate on.
DICT_DOCS, DICT_LONGEST, CALIBRATION_DOCS = 300, 20_000, 6000
LEVEL = 3


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def features(data: bytes, bad, good) -> list[float]:
    n, c0, c1 = len(data), len(bad.compress(data)), len(good.compress(data))
    d, size = (c0 - c1) / (c0 + c1), math.log1p(n) / 10
    return [1.0, d, (c0 - c1) / (n + 20), c1 / (n + 20), size, d * size]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton's method, steps halved while the loss grows."""
    w = np.zeros(x.shape[1])
    loss = lambda v: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v)).sum() + ridge * v @ v / 2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        scale = 1.0
        while loss(w - scale * step) > loss(w) + 1e-12 and scale > 1e-6:
            scale /= 2
        w = w - scale * step
        if np.abs(step * scale).max() < 1e-9:
            break
    return w


class Model:
    """Two dictionaries and the calibration; without both classes, a constant prior."""

    def __init__(self, bad: bytes, good: bytes, weights: np.ndarray | None, prior: float):
        self.bad, self.good, self.weights, self.prior = bad, good, weights, prior
        self.mark = zlib.crc32(bad + good)

    def compressors(self) -> tuple:
        return _compressors(self.bad, self.good)

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        z = float(np.dot(features(text.encode(), *self.compressors()), self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@lru_cache(maxsize=2)
def _compressors(bad: bytes, good: bytes) -> tuple:
    import zstandard as zstd

    made = []
    for raw in (bad, good):
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return tuple(made)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None) -> Model:
    """Fit on a bounded sample of the labelled rows that ``train`` (on id_col) admits.

    The sample is the rows of least hash of the id: for each class DICT_DOCS documents of at
    most DICT_LONGEST bytes, whole, for the dictionaries, and CALIBRATION_DOCS others of any
    length to calibrate on. Only that many ids are broadcast, and only dictionary
    texts (6 MB of a class at most) and numbers reach the driver. Labels other than 0 and 1,
    null ids and null texts are left out; an id labelled both ways counts as bad; of rows with one id,
    each text counts once. Without texts of both classes the model is a constant.
    """
    ids = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    ids = ids.where(train) if train is not None else ids
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    drawn = {y: [(r.doc_id, r.y, r.h) for r in ids.where(F.col("y") == y).orderBy("h", "doc_id").limit(DICT_DOCS * 2 + CALIBRATION_DOCS).collect()] for y in (0, 1)}
    if not drawn[0] or not drawn[1]:
        return Model(b"", b"", None, 0.5 if not drawn[0] + drawn[1] else float(bool(drawn[1])))
    # the dictionary's candidates come first; of small label sets, every other document calibrates
    first = {y: drawn[y][:DICT_DOCS * 2] if len(drawn[y]) > 4 * DICT_DOCS else drawn[y][::2][:DICT_DOCS * 2] for y in (0, 1)}
    spent = {r[0] for y in (0, 1) for r in first[y]}
    rest = sorted((r for y in (0, 1) for r in drawn[y] if r[0] not in spent), key=lambda r: (r[2], r[0]))[:CALIBRATION_DOCS]
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame([(i, y, 1) for y in (0, 1) for i, _, _ in first[y]] + [(i, y, 0) for i, y, _ in rest], "doc_id bigint, y int, role int"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(sample, "doc_id")
    short = texts.where(F.expr("role = 1") & (F.octet_length("text") <= DICT_LONGEST)).select("y", F.xxhash64("doc_id").alias("h"), "doc_id", "text").distinct()
    own = short.selectExpr("y", "text", "h", "doc_id", "row_number() over (partition by y order by h, doc_id, text) as place").where(F.col("place") <= DICT_DOCS)
    found = sorted(own.collect(), key=lambda r: r.place)
    blob = {y: "\n".join(r.text for r in found if r.y == y).encode() for y in (0, 1)}
    if not blob[0] or not blob[1]:
        return Model(b"", b"", None, 0.5)
    shared = spark.sparkContext.broadcast((blob[0], blob[1]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.encode(), *_compressors(*shared.value)) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "y"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    seen = sorted((r.doc_id, r.x, r.y) for r in texts.where("role = 0").select("doc_id", "y", "text").mapInArrow(tidy(measure), "doc_id bigint, y int, x array<double>").collect())
    y = np.array([r[2] for r in seen], float)
    if len(set(y.tolist())) < 2:
        return Model(b"", b"", None, len(drawn[1]) / (len(drawn[0]) + len(drawn[1])))
    return Model(blob[0], blob[1], fit_logistic(np.array([r[1] for r in seen]), y), 0.5)


def quality_scores(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5) of each whole text.

    A null text is empty and scored as such; a very long text is compressed whole. Rows keep
    their number; null ids and repeated rows stay (equal texts score equally); other columns
    are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, _, _ in text_slices(b, "text"):
                s = np.array([shared.value.score(t or "") for t in column(rows, "text").to_pylist()])
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns as they are (whatever their names), whose text scores at least ``least``.

    A null text is scored as an empty one; repeated rows stay or go together; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, _, _ in text_slices(b, text_col):
                yield rows.filter(pa.array([shared.value.score(t or "") >= least for t in column(rows, text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
