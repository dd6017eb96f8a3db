"""A training-data pipeline over ``documents``, stage by stage, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one its own.  A null text counts as
empty; rows of an empty table give an empty table; columns beyond those of documents are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depfleet.llm.stages import STAGES
from depfleet.staging import stage

ORACLE_SQL = None  # similarity classes, latent retrieval and merging have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; a stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, apply in STAGES[:-1]:
        now = stage(apply(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
