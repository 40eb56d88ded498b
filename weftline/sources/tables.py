"""The tables of a data directory, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Columns and filters chosen later reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
