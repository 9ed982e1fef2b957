"""The corpus pipeline: each stage reads what its predecessor kept, and its decisions take effect.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and reread as the next one's docs.
All but the last return the columns of ``documents``. Null and empty texts pass the filters (they are neither toxic, nor
copies, nor leaks), take no share of the mix, and so end there; an empty table stays empty through all stages. A row that
repeats in full is kept once by the second stage; rows of one doc_id with different texts are judged each. Extra columns,
whatever their names, are carried up to the mix. Very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sunstride.llm import decontaminate, jaccard, mixing, toxicity, training_order
from sunstride.llm.common import settled, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, the least doc_id's."""
    return jaccard.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time that a document is taken, cut where its shard's quota ends."""
    return mixing.materialise(docs)


def training_order_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; a row for each document of the mix with its place."""
    return training_order.ordered(docs).drop("path")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("training_order", training_order_stage),
]

#: A trained classifier decides the first stage, so SQL cannot give the rows; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
