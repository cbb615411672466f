"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import exact_dedup, license_scan, line_dedup, mixing, pii, quality_rules, resharding, secret_scan, sentencepiece_viterbi, simhash_bktree
from quarry.llm.shared import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op2_pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_documents(table(spark, sf_dir, "documents"))


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout after a quarter more shards of equal capacity took the sources' place, its touched shards rewritten in the shared folder."""
    return resharding.resharded(table(spark, sf_dir, "documents"), scratch(spark, "reshard"))


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bktree.near_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_site_boilerplate(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_and_decode(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.kept_documents(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_pii_redaction, op3_resharding, op4_simhash_bktree, op5_source_mixing, op6_line_dedup, op7_exact_dedup, op8_license_scan, op9_sentencepiece, op10_quality_rules)
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """
        select doc_id, dup_of, copies from (
            select doc_id, min(doc_id) over (partition by text) dup_of, count(*) over (partition by text) copies,
                   row_number() over (partition by text order by doc_id) place
            from documents where text is not null)
        where place > 1""",
    "op6_line_dedup": line_dedup.SQL,
}
