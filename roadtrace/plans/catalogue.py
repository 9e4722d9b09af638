"""Every registered query with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from roadtrace.plans.registry import ORACLES, QUERIES, Query

for _name in ("ordered", "aggregates", "spatial", "graph", "text", "recordings", "features", "roads", "gates", "replay", "ways"):
    import_module(f"roadtrace.plans.{_name}")


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Per drive: turns, rows, gaps."""
    return QUERIES["drive_gap_summary"](spark, root)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
