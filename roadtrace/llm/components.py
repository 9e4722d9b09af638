"""Connected components of a link table that never leaves Spark.

Alternating star contraction: each node passes its smallest neighbour to its larger neighbours, then the smaller
neighbours of a node are tied to the smallest of them. Every round works on tables of at most one row a link, is a
group and a window on the node, and ends in checkpoint(), so a lost executor costs at most a round. A hub may have a
third of all links: its minimum is combined before the shuffle, and the links that learn it are dealt to ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.llm import textkit as tk

SALTS = 16


def _joined(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (u, v) with the m of their u; v is never null.

    A window over both tables, since Spark takes a join to be as large as the product of its sides and checkpoint() keeps that
    estimate: joins would raise it to a power in every round, to numbers of megabytes each in the driver.
    """
    spread = least.select("u", F.lit(None).alias("v"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = rows.select("u", "v", F.lit(None).alias("m"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
    return asked.union(spread).withColumn("m", F.min("m").over(Window.partitionBy("u", "salt"))).filter("v IS NOT NULL").drop("salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node with a link to another; label is the component's smallest node."""
    tk.checkpoint_dir(links.sparkSession)
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().checkpoint()
    state = None
    while True:
        # Large star: u's larger neighbours get u's smallest neighbour.
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = _joined(both.filter("v > u"), least).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # Small star: u's smaller neighbours and u get the smallest of them.
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = _joined(large, smaller).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct().checkpoint()
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = new
        # Spark drops the shuffles and checkpoints of former rounds only once the driver's collector has found them unused.
        links.sparkSession.sparkContext._jvm.System.gc()
