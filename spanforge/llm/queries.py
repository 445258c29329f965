"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chaining, descent, kneserney, langid, marginal, mixing, sharding, simhash, spmodel, topk
from .session import table


def op1_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 20; see topk.bm25_top."""
    docs = table(spark, sf_dir, "documents")
    return topk.bm25_top(docs, docs.where(docs["doc_id"] % 20 == 0))


def op2_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice and base scores of every document; see marginal.score."""
    return marginal.score(table(spark, sf_dir, "documents"))


def op3_word_first_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; see langid.identify."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector; see descent.near_duplicates."""
    return descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; see simhash.simhash_components."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law "rows"; see sharding.shuffled."""
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) of every document: its pieces, and whether they decode to the text."""
    return spmodel.encoded(spark, table(spark, sf_dir, "documents"), ["doc_id"])


def op8_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents repeat from earlier ones; see chaining.passages."""
    return chaining.passages(table(spark, sf_dir, "documents"))


def op9_proportional_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, target weight, probability and decision of every document; see mixing.mix."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and decision of every document; see kneserney.judged."""
    return kneserney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "lang"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_block_max_search": op1_block_max_search,
        "op2_lattice_likelihood": op2_lattice_likelihood,
        "op3_word_first_langid": op3_word_first_langid,
        "op4_nn_descent": op4_nn_descent,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_two_pass_shuffle": op6_two_pass_shuffle,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_collinear_chaining": op8_collinear_chaining,
        "op9_proportional_mixing": op9_proportional_mixing,
        "op10_kneser_ney_quality": op10_kneser_ney_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_block_max_search": topk.oracle(), "op9_proportional_mixing": mixing.oracle()}
