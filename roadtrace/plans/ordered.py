"""Ordered and windowed queries over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.operators import ordered as o
from roadtrace.plans.registry import query
from roadtrace.sources.tables import table

MINUTE = 60_000_000
_US = "epoch_us(ts)"


def events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", "user_id", "event_type", "value", "props", "ts", o.micros().alias("t"))


@query(f"""
SELECT user_id, event_id, t - p AS gap_us, p AS previous_us FROM (
  SELECT user_id, event_id, {_US} AS t, lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
WHERE t - p > 3600000000""")
def sensor_gaps(spark: SparkSession, root: str) -> DataFrame:
    """WIN01, WIN02: gaps above an hour."""
    found = o.gaps(events(spark, root), ["user_id"], "t", "event_id", 60 * MINUTE, o.by_day("t"))
    return found.select("user_id", "event_id", F.col("gap").alias("gap_us"), F.col("previous_time").alias("previous_us"))


_ISLANDS = f"""
SELECT user_id, island, count(*) AS n, min(t) AS begin_us, max(t) AS end_us, round(sum(value), 4) AS angle FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM (
    SELECT user_id, event_id, value, {_US} AS t, CASE WHEN {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM events))
GROUP BY 1, 2"""


@query("SELECT user_id, CAST(island AS BIGINT) AS island, n, begin_us, end_us, angle FROM (" + _ISLANDS + ")")
def turn_islands(spark: SparkSession, root: str) -> DataFrame:
    """WIN09: runs split at half an hour of silence, with their sum."""
    runs = o.islands(events(spark, root), ["user_id"], "t", "event_id", 30 * MINUTE, o.by_day("t"))
    return runs.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min("t").alias("begin_us"), F.max("t").alias("end_us"), F.round(F.sum("value"), 4).alias("angle"))


@query(f"""
WITH i AS ({_ISLANDS}), g AS (
  SELECT user_id, count(*) AS gaps, max(d) AS longest_us FROM (SELECT user_id, {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d > 3600000000 GROUP BY 1)
SELECT user_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(n) AS BIGINT) AS rows_seen, max(n) AS longest_turn, coalesce(any_value(gaps), 0) AS gaps, coalesce(any_value(longest_us), 0) AS longest_gap_us
FROM i LEFT JOIN g USING (user_id) GROUP BY user_id""")
def drive_gap_summary(spark: SparkSession, root: str) -> DataFrame:
    """AGG01, WIN02, WIN09: per drive, its turns and its gaps."""
    turns = turn_islands(spark, root).groupBy("user_id").agg(F.count("*").alias("turns"), F.sum("n").alias("rows_seen"), F.max("n").alias("longest_turn"))
    found = sensor_gaps(spark, root).groupBy("user_id").agg(F.count("*").alias("gaps"), F.max("gap_us").alias("longest_gap_us"))
    return turns.join(found, "user_id", "left").fillna(0, ["gaps", "longest_gap_us"])


@query("SELECT event_type AS kind, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20")
def last_n_per_kind(spark: SparkSession, root: str) -> DataFrame:
    """WIN22: the last 20 rows of each kind."""
    return o.last_n(events(spark, root), "event_type", [F.desc("t"), F.desc("event_id")], 20).select(F.col("event_type").alias("kind"), "event_id", "user_id")


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, {_US} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT user_id, event_id, t, n FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, t, n FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.n) AS first FROM k JOIN e ON e.user_id = k.user_id AND e.n > k.n AND e.t - k.t >= 3600000000) WHERE first = 1)
SELECT user_id, event_id, CAST(coalesce(n - lag(n) OVER (PARTITION BY user_id ORDER BY n) - 1, 0) AS BIGINT) AS suppressed FROM k""")
def throttle_hourly(spark: SparkSession, root: str) -> DataFrame:
    """WIN15: at most one row an hour per user, counted from the last kept."""
    kept = o.throttle(events(spark, root).select("user_id", "event_id", "t"), ["user_id"], "t", "event_id", 60 * MINUTE, o.by_day("t"))
    return kept.select("user_id", "event_id", "suppressed")


@query(f"""
SELECT user_id, {_US} // 900000000 AS block, count(*) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) END, 4) AS error FROM events GROUP BY 1, 2""")
def tumbling_blocks(spark: SparkSession, root: str) -> DataFrame:
    """WIN07, AGG20: means of quarter-hour blocks and their standard error."""
    blocks = events(spark, root).groupBy("user_id", F.floor(F.col("t") / (15 * MINUTE)).alias("block"))
    return blocks.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.when(F.count("*") > 1, F.stddev_samp("value") / F.sqrt(F.count("*"))), 4).alias("error"))


@query(f"""
SELECT w * 900000000 AS window_start, count(*) AS n, round(sum(value), 2) AS total, round(max(value), 4) AS peak FROM (
  SELECT value, unnest(range(({_US} - 3600000000) // 900000000 + 1, {_US} // 900000000 + 1)) AS w FROM events) GROUP BY 1""")
def hopping_stats(spark: SparkSession, root: str) -> DataFrame:
    """WIN06: hour windows each quarter of an hour."""
    hops = o.hopping(events(spark, root), "t", 60 * MINUTE, 15 * MINUTE)
    return hops.groupBy("window_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.max("value"), 4).alias("peak"))


@query(f"""
SELECT event_id, n, round(sqrt(s / n), 4) AS rms FROM (
  SELECT event_id, count(*) OVER w AS n, sum(value * value) OVER w AS s FROM (SELECT *, {_US} AS t FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW))""")
def rolling_rms(spark: SparkSession, root: str) -> DataFrame:
    """WIN05, AGG09: root mean square over the last six hours."""
    square = F.col("value") * F.col("value")
    seen = o.rolling(events(spark, root), ["user_id"], "t", 360 * MINUTE, {"n": lambda w: F.count("*").over(w), "s": lambda w: F.sum(square).over(w)})
    return seen.select("event_id", "n", F.round(F.sqrt(F.col("s") / F.col("n")), 4).alias("rms"))


@query(f"""
SELECT event_id, round(sum(a) OVER (PARTITION BY user_id ORDER BY t, event_id), 2) AS distance FROM (
  SELECT *, CASE WHEN t - lag(t) OVER w <= 7200000000 THEN (value + lag(value) OVER w) / 2 * ((t - lag(t) OVER w) / 1e6) ELSE 0 END AS a FROM (SELECT *, {_US} AS t FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))""")
def trapezoid_distance(spark: SparkSession, root: str) -> DataFrame:
    """WIN04: running distance from speeds, segmented at gaps over two hours."""
    run = o.trapezoid(events(spark, root), ["user_id"], "t", "event_id", "value", 120 * MINUTE, o.by_day("t"))
    return run.select("event_id", F.round("distance", 2).alias("distance"))


@query("""
SELECT e.event_id, e.user_id, p.event_id AS held_id, p.value AS held_value
FROM (SELECT *, row_number() OVER () AS r FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def hold_last_join(spark: SparkSession, root: str) -> DataFrame:
    """JOI11, JOI12: each error with its user's last purchase at or before it."""
    e = events(spark, root)
    left = e.filter("event_type = 'error'").select("user_id", "event_id", "t")
    right = e.filter("event_type = 'purchase'").select("user_id", "event_id", "t", "value")
    held = o.hold_last(left, right, ["user_id"], "t", ["event_id", "value"], o.by_day("t"), tie="event_id")
    return held.select("event_id", "user_id", F.col("held.event_id").alias("held_id"), F.col("held.value").alias("held_value"))


@query(f"""
WITH s AS (SELECT user_id, {_US} AS t, max(event_id) AS id, arg_max(value, event_id) AS hi, arg_min(value, event_id) AS lo FROM events GROUP BY 1, 2),
g AS (SELECT user_id, h * 3600000000 AS t FROM (SELECT user_id, unnest(range(min(t) // 3600000000, max(t) // 3600000000 + 1)) AS h FROM s GROUP BY user_id)),
x AS (SELECT g.user_id, g.t, b.t AS t0, b.hi AS v0, a.t AS t1, a.lo AS v1 FROM g ASOF JOIN s b ON g.user_id = b.user_id AND g.t >= b.t ASOF JOIN s a ON g.user_id = a.user_id AND g.t <= a.t)
SELECT user_id, t AS at_us, round(CASE WHEN t1 > t0 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) ELSE v0 END, 4) AS value FROM x""")
def interpolated_join(spark: SparkSession, root: str) -> DataFrame:
    """JOI13, WIN23: values on a uniform hourly grid, linear between neighbours."""
    e = events(spark, root).select("user_id", "t", "event_id", "value")
    span = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    hour = 60 * MINUTE
    grid = span.select("user_id", F.explode(F.transform(F.sequence(F.floor(F.col("a") / hour), F.floor(F.col("b") / hour)), lambda k: k * F.lit(hour))).alias("t"), F.lit(0).cast("long").alias("event_id"))
    at = o.interpolated(grid, e, ["user_id"], "t", "value", o.by_day("t"), tie="event_id")
    return at.filter("value IS NOT NULL").select("user_id", F.col("t").alias("at_us"), F.round("value", 4).alias("value"))


@query(f"""
SELECT user_id, count(*) AS episodes FROM (
  SELECT user_id, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
WHERE bad AND coalesce(NOT was, true) GROUP BY 1""")
def episode_counts(spark: SparkSession, root: str) -> DataFrame:
    """WIN17: rising edges of a flag."""
    e = events(spark, root).withColumn("bad", F.col("event_type") == "error")
    before = o.with_previous(e, ["user_id"], ["t", "event_id"], ["bad"], o.by_day("t"))
    return before.filter(F.col("bad") & ~F.coalesce("previous.bad", F.lit(False))).groupBy("user_id").agg(F.count("*").alias("episodes"))


@query(f"""
SELECT user_id, round(first(t ORDER BY t, event_id) FILTER (c >= total / 2), 0) AS half_us FROM (
  SELECT user_id, event_id, {_US} AS t, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c, sum(value) OVER (PARTITION BY user_id) AS total FROM events)
GROUP BY user_id""".replace("round(first(t ORDER BY t, event_id) FILTER (c >= total / 2), 0)", "min(t) FILTER (c >= total / 2)"))
def half_angle_time(spark: SparkSession, root: str) -> DataFrame:
    """WIN19: when the running sum first reaches half of its total."""
    e = events(spark, root)
    run = o.running_sum(e, ["user_id"], ["t", "event_id"], F.col("value"), o.by_day("t"), "c")
    totals = e.groupBy("user_id").agg(F.sum("value").alias("total"))
    return run.join(totals, "user_id").groupBy("user_id").agg(F.min(F.when(F.col("c") >= F.col("total") / 2, F.col("t"))).alias("half_us"))


@query(f"""
SELECT event_id, CASE WHEN d <= 0 THEN 'non_increasing' WHEN d > 10800000000 THEN 'fix_gap' WHEN d > 3600000000 THEN 'stale' ELSE 'ok' END AS flag FROM (
  SELECT event_id, {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events)""")
def clock_flags(spark: SparkSession, root: str) -> DataFrame:
    """WIN25, FLT03: anomalies of the clock in arrival order."""
    e = events(spark, root)
    before = o.with_previous(e, ["user_id"], ["event_id"], ["t"], F.floor(F.col("event_id") / 100_000))
    d = F.col("t") - F.col("previous.t")
    flag = F.when(d <= 0, "non_increasing").when(d > 180 * MINUTE, "fix_gap").when(d > 60 * MINUTE, "stale").otherwise("ok")
    return before.select("event_id", flag.alias("flag"))


@query("""
WITH p AS (SELECT event_id, user_id, event_type, value, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS source, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour FROM events)
SELECT user_id, hour, event_id, event_type, value FROM p QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY source, event_id) = 1""")
def kind_dispatch_union(spark: SparkSession, root: str) -> DataFrame:
    """FLT13, SET01: rows dispatched by kind, united with precedence, one per user and hour."""
    e = events(spark, root).withColumn("hour", F.floor(F.col("t") / (60 * MINUTE)))
    kinds = [F.col("event_type") == "error", F.col("event_type") == "purchase", ~F.col("event_type").isin("error", "purchase")]
    firsts = [e.filter(k).groupBy("user_id", "hour").agg(F.min_by(F.struct("event_id", "event_type", "value"), "event_id").alias("r")).select("user_id", "hour", "r.*") for k in kinds]
    return o.first_wins(firsts, ["user_id", "hour"])
