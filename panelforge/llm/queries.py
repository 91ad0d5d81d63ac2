"""The registered queries of this subpackage: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table as table
from . import oracles


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("partner_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, fold, quality_scores

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train=fold("doc_id", 3) != 1)
    return quality_scores(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linkgraph import link_filter

    return link_filter(table(spark, sf_dir, "pages"))


def op7_piecewise_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctph import ctph_edited

    return ctph_edited(table(spark, sf_dir, "documents"))


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_estimates

    return pack(token_estimates(table(spark, sf_dir, "documents")))


def op9_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_naming import block_naming_dedup

    return block_naming_dedup(table(spark, sf_dir, "documents"))


def op10_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import detect_languages, fit_languages
    from .quality import fold

    docs = table(spark, sf_dir, "documents")
    filters = fit_languages(docs, train=fold("doc_id", 4) != 2)
    return detect_languages(docs, filters).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_sparse_suffix_dedup": op2_sparse_suffix_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_pii_anchors": op4_pii_anchors,
        "op5_compression_quality": op5_compression_quality,
        "op6_link_graph": op6_link_graph,
        "op7_piecewise_hashing": op7_piecewise_hashing,
        "op8_length_buckets": op8_length_buckets,
        "op9_block_naming_dedup": op9_block_naming_dedup,
        "op10_bitmask_langid": op10_bitmask_langid,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": oracles.NGRAM_JOIN,
        "op2_sparse_suffix_dedup": oracles.REPEATED_PASSAGES,
        "op6_link_graph": oracles.LINK_GRAPH,
        "op9_block_naming_dedup": oracles.BLOCK_NAMING,
    }
