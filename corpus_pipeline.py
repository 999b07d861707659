"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, sampled pieces.

Every stage is written as Parquet beside the session's checkpoints and read again as the documents of the next. SQL cannot express the
stages; tests/llm hold the result against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekgrain.llm.common import stored, table
from weekgrain.llm.stages import STAGES

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
