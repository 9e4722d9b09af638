"""Recordings and live input: the event table, written as drive recordings or read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.operators.ordered import micros
from roadtrace.plans.ordered import MINUTE
from roadtrace.plans.registry import ORACLES, query
from roadtrace.sources import recordings as r
from roadtrace.sources.tables import table
from roadtrace.streaming import live


def _entries(spark: SparkSession, root: str) -> DataFrame:
    """Events as recording rows: clicks and views are samples, the rest events."""
    e = table(spark, root, "events").withColumn("t", micros() / 1e6)
    sample = F.when(F.col("event_type").isin("click", "view"), F.struct(F.col("t").alias("time"), F.col("value").alias("yawRate")))
    kind = F.when(F.col("event_type").isin("click", "view"), "sample").when(F.col("event_type") == "error", "gps-trace-event").otherwise("event")
    return e.select(F.col("user_id").alias("drive"), kind.alias("kind"), F.col("event_id").cast("double").alias("receivedUptime"), sample.alias("sample"), F.when(kind == "event", F.col("event_type")).alias("event"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS drive, count(*) AS n, count(DISTINCT CASE WHEN event_type IN ('click', 'view') THEN 'sample' WHEN event_type = 'error' THEN 'gps' ELSE 'event' END) AS kinds,
  round(min(epoch_us(ts)) FILTER (event_type IN ('click', 'view')) / 1e6, 3) AS first, round(max(epoch_us(ts)) FILTER (event_type IN ('click', 'view')) / 1e6, 3) AS last, count(*) AS last_sequence FROM events GROUP BY 1""")
def recording_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """SRC01, SNK01, AGG02: events written as JSON lines, a folder a drive, and read back strictly."""
    folder = r.scratch(spark)
    r.write_recordings(_entries(spark, root), folder, "drive")
    rows = r.read_recordings(spark, folder, folders=True)
    out = r.summary(rows).join(rows.groupBy("drive").agg(F.max("sequence").alias("last_sequence")), "drive")
    return out.select("drive", "n", "kinds", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), "last_sequence")


@query("""
SELECT CAST(user_id AS VARCHAR) AS drive, count(*) FILTER (event_type IN ('click', 'view')) AS samples, count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS events FROM events WHERE event_type <> 'error' GROUP BY 1""")
def replayed_rows(spark: SparkSession, root: str) -> DataFrame:
    """FLT13: rows that would drive a replay, by kind."""
    rows = r.replayed(_entries(spark, root).withColumns({"raw": F.lit(None).cast(r.RAW)}))
    return rows.groupBy(F.col("drive").cast("string").alias("drive")).agg(F.count_if(F.col("kind") == "sample").alias("samples"), F.count_if(F.col("kind") == "event").alias("events"))


@query()
def stream_throttle(spark: SparkSession, root: str) -> DataFrame:
    """STR09: the hourly throttle as a stateful stream over the event files."""
    schema = table(spark, root, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/events*.parquet").select("user_id", micros().alias("t"), "event_id")
    kept = live.run_to_end(live.throttled(stream, "user_id", "t", "event_id", 60 * MINUTE), r.scratch(spark))
    return kept.select("user_id", "event_id", "suppressed")


ORACLES["stream_throttle"] = ORACLES["throttle_hourly"]


@query("SELECT epoch_us(ts) // 86400000000 AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_blocks(spark: SparkSession, root: str) -> DataFrame:
    """WIN07 on Structured Streaming: daily blocks behind a watermark."""
    schema = table(spark, root, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/events*.parquet").select(F.timestamp_micros(micros()).alias("ts"), "value")
    done = live.run_to_end(live.blocks(stream, "ts", "value", "1 day", "1 hour"), r.scratch(spark), mode="complete")
    return done.select(F.floor(F.unix_micros("start") / 86_400_000_000).alias("day"), "n", F.round("total", 2).alias("total"))
