"""The corpus pipeline: quality filter, near-duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkindex.llm.pipeline import ORACLE_SQL, STAGES, run_stages

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the table documents."""
    return run_stages(spark, sf_dir)
