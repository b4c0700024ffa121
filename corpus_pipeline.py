"""A training corpus from ``documents``: quality, toxicity, near-duplicates, mixing and packing, each on all that the stage before kept.

``STAGES`` lists the stages; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the columns of
``documents``; mixing repeats a document as often as its source's target asks. The last returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm import common, mixing, packing, quality, simhash_dedup, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.learn(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not found toxic."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dedup.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken, and repeated, so that sources come to their target weights."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of fixed windows of tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash_near_dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Classifiers, fingerprints and tokens have no SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``; what each returns is written as Parquet in the shared folder and read again as the next one's input."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs, f"stage-{name}")
    return docs
