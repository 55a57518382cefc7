"""Readers for the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``, one file or a directory of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
