"""Corpus pipeline: quality classifier, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read back as the next one's docs. All but the last keep the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.block_naming import ascii_lower, block_naming_dedup
from panelforge.llm.kit import release, stash
from panelforge.llm.ngram_join import ngram_jaccard_join
from panelforge.llm.packing import pack, token_estimates
from panelforge.llm.pii import mask_column
from panelforge.llm.quality import fit_quality, fold, keep_good
from panelforge.llm.sieve import anti, maybe_in
from panelforge.session import read_table


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have (names are compared without case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go (score under 0.5).

    Whole texts are scored, a null text as an empty one; rows of one text stay or go
    together; without labels of both kinds every score is the same constant. Other columns are
    kept whatever their names; an empty table gives an empty result.
    """
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"), train=fold("doc_id", 3) != 1)
    return keep_good(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, one row stays: the largest doc_id's, and of its rows the first in JSON form.

    A null text counts as empty; null ids stay only where their text has no other. An id may stand for
    several texts: each is decided on its own. Other columns are kept whatever their names;
    very long texts are compared whole; an empty table gives an empty result.
    """
    gone = stash(block_naming_dedup(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_gone")).distinct())
    # only rows of an id that goes or is repeated are hashed and moved
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"))
    ids = stash(gone.select("_id").union(again).distinct())
    doubt = maybe_in(ids.select(F.xxhash64(F.col("_id").cast("bigint")).alias("h")), "h")(F.xxhash64(F.col("doc_id").cast("bigint")))
    sha = _unused(docs, "text_hash")
    near = docs.where(doubt).withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))
    kept = near.join(gone, near.doc_id.eqNullSafe(gone._id) & (near[sha] == gone._gone), "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.where(~doubt).unionByName(kept.groupBy("doc_id", sha).agg(F.min_by(row, F.to_json(row)).alias(sha + "_")).select(f"{sha}_.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 stays: the least doc_id.

    An id that several texts share goes only if each of them would. Null, empty and
    blank texts are linked with nothing and stay; a null id stays. Other columns are kept
    whatever their names; an empty table gives an empty result.
    """
    linked = ngram_jaccard_join(docs)
    gone = stash(linked.groupBy("doc_id").agg(F.every(F.col("doc_id") != F.col("component_id")).alias("go")).where("go").select("doc_id"))
    return anti(docs, gone, ["doc_id"])


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data in a text is replaced by its kind; n_chars follows the text if it is a column.

    Rows and other columns stay as they are; a null text stays null (as does its n_chars); an
    empty table gives an empty result.
    """
    out = mask_column(docs)
    if "n_chars" in out.columns:
        kind = dict(out.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket and token-budget batch of each row; lengths are estimates in tokens, null texts 0.

    Repeated rows each get a slot; other columns are left out; an empty table gives an
    empty result.
    """
    return pack(token_estimates(docs))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("packing", pack_lengths),
]

#: Compression scores and optimal buckets have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back."""
    docs = read_table(spark, sf_dir, "documents")
    held = []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
            held.append(docs)
    out = stash(docs)
    release(*held)
    return out
