"""A training corpus from raw documents, as stages that each rewrite the table
``documents``: every stage takes (spark, docs, sf_dir) and returns a DataFrame.

Of every stage: rows are judged one by one, so rows with a null or a repeated doc_id
stay rows of their own; further columns go along, whatever their names; texts are
looked at whole, however long; no rows give no rows. What else is special is said
at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import decontaminate, mixing, quality, secrets, simhash
from sessionloom.runtime import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a null or empty text is scored
    as one without words."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id;
    of rows that share it, one. Texts without words are a group, null ones among them."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than a twentieth of benchmark passages. Texts without
    words, null ones among them, stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; null and empty texts as they are."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the targets for sources, languages
    and topics, or are all there are where a target is more than that; each
    document with its probability ``p_selected``, in place of such a column. Texts
    without words, null ones among them, are never drawn; rows that share a doc_id
    share their draw."""
    return mixing.sample(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]

ORACLE_SQL = None  # learned models and fingerprints: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
