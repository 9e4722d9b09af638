"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table under ``root``, a file or a folder, in any store that Spark reads."""
    return spark.read.parquet(f"{root}/{name}.parquet")
