"""Stored tables, one Parquet file or folder each."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The stored table ``name``; Parquet carries its schema, nothing is inferred."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
