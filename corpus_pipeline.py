"""From raw documents to token ids, stage by stage; each stage works on all that the one before it kept.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns have in each stage the result that the docstring of
its operator in quarry.llm states; texts are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, mixing, quality_rules, sentencepiece_viterbi, simhash_bktree
from quarry.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned rule rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, those with null or repeated ids among them."""
    return simhash_bktree.drop_near_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their tempered weights, to the token."""
    return mixing.select_mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts."""
    return sentencepiece_viterbi.encode_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("source mixing", mix),
    ("SentencePiece encoding", encode),
]

#: SQL can neither learn rules nor merge pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
