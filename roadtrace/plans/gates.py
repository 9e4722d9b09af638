"""Gates, fixes, trails and records over events; one user is a drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.functions import geometry as geo
from roadtrace.functions import motion as m
from roadtrace.functions import quality as ql
from roadtrace.functions import signal
from roadtrace.operators import aggregates as a
from roadtrace.operators import features as f
from roadtrace.operators import ordered as o
from roadtrace.operators import spatial as s
from roadtrace.plans.registry import query
from roadtrace.sources import recordings as r
from roadtrace.sources.tables import table
from roadtrace.streaming import live

_FIX = """fix AS (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 95.0 ELSE value END AS latitude, value * 2 AS longitude, CASE WHEN event_id % 37 = 0 THEN NULL ELSE event_id * 1.0 END AS timestamp, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 10 - 2 END AS age,
  value - 3 AS horizontal, value AS altitude, (event_id % 11) - 1.0 AS vertical, value - 1 AS speed, (event_id % 7) - 1.0 AS speed_accuracy, value * 5 AS course, (event_id % 13) - 1.0 AS course_accuracy, event_id % 17 = 0 AS reduced, event_id % 19 = 0 AS simulated, event_id % 23 = 0 AS accessory FROM events)"""

_FLAGS = [
    ("invalid_coordinate", "latitude IS NULL OR longitude IS NULL OR abs(latitude) > 90 OR abs(longitude) > 180"), ("invalid_timestamp", "timestamp IS NULL"), ("stale_fix", "age > 3"), ("future_fix", "age < -1"),
    ("invalid_horizontal_accuracy", "horizontal IS NULL OR horizontal < 0"), ("poor_horizontal_accuracy", "horizontal > 25"), ("invalid_altitude", "vertical IS NULL OR vertical < 0 OR altitude IS NULL"),
    ("invalid_speed", "speed < 0 OR speed_accuracy < 0 OR speed IS NULL"), ("poor_speed_accuracy", "NOT (speed < 0 OR speed_accuracy < 0) AND speed_accuracy > 3"), ("invalid_course", "course < 0 OR course >= 360 OR course_accuracy < 0 OR course IS NULL"),
    ("reduced_accuracy", "reduced"), ("software_simulation", "simulated"), ("accessory_source", "accessory"),
]


@query(f"WITH {_FIX} SELECT event_id, concat_ws(',', {', '.join(f'CASE WHEN {rule} THEN {chr(39)}{name}{chr(39)} END' for name, rule in _FLAGS)}) AS flags FROM fix")
def fix_quality(spark: SparkSession, root: str) -> DataFrame:
    """FLT09: the thirteen flags of every fix."""
    e, v = F.col("event_id"), F.col("value")
    fix = F.struct(
        F.when(e % 41 == 0, 95.0).otherwise(v).alias("latitude"), (v * 2).alias("longitude"), F.when(e % 37 != 0, e.cast("double")).alias("timestamp"), F.when(e % 5 != 0, v / 10 - 2).alias("age"), (v - 3).alias("horizontal"), v.alias("altitude"),
        ((e % 11) - 1.0).alias("vertical"), (v - 1).alias("speed"), ((e % 7) - 1.0).alias("speed_accuracy"), (v * 5).alias("course"), ((e % 13) - 1.0).alias("course_accuracy"), (e % 17 == 0).alias("reduced"), (e % 19 == 0).alias("simulated"), (e % 23 == 0).alias("accessory"),
    )
    return table(spark, root, "events").select("event_id", fix.alias("fix")).select("event_id", F.array_join(ql.gps_flags(F.col("fix")), ",").alias("flags"))


@query("""
SELECT event_id, g BETWEEN 0.5000000001 AND 1.4999999999 AND event_id % 29 <> 0 AND value IS NOT NULL AS sound,
  CASE WHEN value - 2 < 0 OR value - 2 > 45 THEN 'speed_range' WHEN event_id % 31 = 0 THEN 'wheelbase' END AS vibration,
  CASE WHEN value > 55 THEN 'speed_range' WHEN event_id % 22 < 1 OR event_id % 22 > 20 THEN 'sigma_range' WHEN event_id % 12 / 10.0 < 0.2 OR event_id % 12 / 10.0 > 1 THEN 'quality_range' END AS visual
FROM (SELECT *, sqrt(power(value / 40, 2) + power((event_id % 10) / 10.0, 2)) AS g FROM events)""")
def observation_gates(spark: SparkSession, root: str) -> DataFrame:
    """FLT01, FLT02, FLT10: raw frames with a gravity of about one g; why speeds are refused."""
    e, v = F.col("event_id"), F.col("value")
    gravity = F.array(v / 40, (e % 10) / 10.0, F.lit(0.0))
    spin = F.when(e % 29 == 0, F.array(v, F.lit(float("nan")), v)).otherwise(F.array(v, v, v))
    return table(spark, root, "events").select(
        "event_id", ql.valid_raw(F.array(v, v, v), spin, gravity).alias("sound"), ql.vibration_gate(v - 2, F.when(e % 31 == 0, 0.0).otherwise(2.7)).alias("vibration"),
        ql.visual_gate(v, (e % 22).cast("double"), (e % 12) / 10.0).alias("visual"),
    )


@query("""
SELECT user_id, epoch_us(ts) // 3600000000 AS batch, max_by(event_id, (epoch_us(ts), event_id)) AS newest, count(*) AS batch_size FROM events GROUP BY 1, 2""")
def newest_fix(spark: SparkSession, root: str) -> DataFrame:
    """SRC11: the newest fix of each hourly batch, with the batch's size."""
    e = table(spark, root, "events").withColumn("t", o.micros())
    return e.groupBy("user_id", F.floor(F.col("t") / 3_600_000_000).alias("batch")).agg(F.max_by("event_id", F.struct("t", "event_id")).alias("newest"), F.count("*").alias("batch_size"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, value AS x, (event_id % 97) / 3.0 AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, x AS kx, y AS ky, true AS kept FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.n, CASE WHEN d THEN e.x ELSE kx END, CASE WHEN d THEN e.y ELSE ky END, d FROM (SELECT w.kx, w.ky, e.*, sqrt(power(e.x - kx, 2) + power(e.y - ky, 2)) > 20 AS d FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) e)
SELECT user_id, event_id FROM w WHERE kept""")
def thinned_trail(spark: SparkSession, root: str) -> DataFrame:
    """WIN21: points more than twenty from the last kept."""
    e = table(spark, root, "events").select("user_id", "event_id", F.col("value").alias("x"), ((F.col("event_id") % 97) / 3.0).alias("y"))
    return o.thin(e, ["user_id"], ["event_id"], ("x", "y"), 20).select("user_id", "event_id")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id AS t, value AS x, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS width, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT user_id, n, t, t AS begun, CAST(0 AS DOUBLE) AS mass, CAST(0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS mean FROM e WHERE n = 1 UNION ALL
  SELECT user_id, n, t, CASE WHEN out THEN t ELSE begun END, CASE WHEN out THEN 0 ELSE mass END, CASE WHEN out THEN 0 ELSE total END, CASE WHEN out THEN total / mass END
  FROM (SELECT e.user_id, e.n, e.t, w.begun, w.mass + e.width AS mass, w.total + e.width * e.x AS total, e.t - w.begun >= 2000 AS out FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT user_id, t AS event_id, round(mean, 4) AS mean FROM w WHERE mean IS NOT NULL""")
def downsampled_events(spark: SparkSession, root: str) -> DataFrame:
    """WIN16: duration-weighted means, a row when two thousand have passed."""
    e = table(spark, root, "events").select("user_id", "event_id", "value")
    return f.downsampled(e, "user_id", "event_id", ["value"], 2000, F.floor(F.col("event_id") / 100_000)).select("user_id", "event_id", F.round("value", 4).alias("mean"))


@query("""
WITH RECURSIVE e AS (SELECT l_suppkey AS route, l_orderkey * 10 + l_linenumber AS middle, sum(l_quantity - 25.5) AS angle, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem GROUP BY 1, 2),
w AS (SELECT route, n, middle AS pos, angle AS a, CAST(NULL AS BIGINT) AS closed FROM e WHERE n = 1 UNION ALL
  SELECT route, n, CASE WHEN same AND abs(angle) <= abs(a) THEN pos ELSE middle END, CASE WHEN same AND abs(angle) <= abs(a) THEN a ELSE angle END, CASE WHEN NOT same THEN pos END
  FROM (SELECT e.*, w.pos, w.a, e.middle - w.pos < 150 AND (e.angle > 0) = (w.a > 0) AS same FROM w JOIN e ON e.route = w.route AND e.n = w.n + 1))
SELECT route, closed AS middle FROM w WHERE closed IS NOT NULL UNION ALL SELECT route, max_by(pos, n) FROM w GROUP BY 1""")
def distinct_bends(spark: SparkSession, root: str) -> DataFrame:
    """WIN12: of near neighbours with the same sense the larger angle."""
    l = table(spark, root, "lineitem").groupBy(F.col("l_suppkey").alias("route"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("middle")).agg(F.sum(F.col("l_quantity") - 25.5).alias("angle"))
    return f.distinct_bends(l, "route", 150).select("route", "middle")


@query("""
SELECT o_orderkey, round(gx, 4) + 0.0 AS forward, round(up, 4) + 0.0 AS up FROM (SELECT o_orderkey, o_totalprice / 1e5 AS v, CASE WHEN lz > 0.45 THEN -(o_totalprice / 1e5) * lz + 0 * lz END AS gx, CASE WHEN lz > 0.45 THEN o_totalprice / 1e5 * uz - uy * 0 END AS up
  FROM (SELECT *, -gz / sqrt(gy * gy + gz * gz) AS uz, -gy / sqrt(gy * gy + gz * gz) AS uy, abs(gy) / sqrt(gy * gy + gz * gz) AS lz FROM (SELECT *, -(0.2 + (o_orderkey % 9) / 10.0) AS gy, (o_custkey % 15) / 10.0 - 0.7 AS gz FROM orders)))""")
def vehicle_axes(spark: SparkSession, root: str) -> DataFrame:
    """FN12: a device vector along its own z in the vehicle's axes."""
    g = F.array(F.lit(0.0), -(F.lit(0.2) + (F.col("o_orderkey") % 9) / 10.0), (F.col("o_custkey") % 15) / 10.0 - 0.7)
    v = geo.vehicle_axes(g, F.array(F.lit(0.0), F.lit(0.0), F.col("o_totalprice") / 1e5))
    return table(spark, root, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", (F.round("v.forward", 4) + 0.0).alias("forward"), (F.round("v.up", 4) + 0.0).alias("up"))


@query("""
SELECT l_orderkey, l_linenumber, count(*) AS n, round(0.987654321 * sum(CASE WHEN l_quantity > 5 THEN l_extendedprice * greatest(0, least(1, l_tax * 10 / l_quantity)) END), 1) AS left_over,
  round(sum(2 * (sqrt(greatest(0, l_tax)) + sqrt(greatest(0, v * t * t - c * t * t * t + b * power(t, 4) / 4 + 0.0049 * power(t, 3) / 3 + 0.000016 * power(t, 5) / 20)))), 2) AS radius
FROM (SELECT *, greatest(-sqrt(v * b), least(l_discount / 100, sqrt(v * b))) AS c FROM (SELECT *, greatest(l_discount, 0.0225) AS v, greatest(l_tax / 1000, 0.000016) AS b, l_quantity / 2 AS t FROM lineitem)) GROUP BY 1, 2""")
def trip_progress(spark: SparkSession, root: str) -> DataFrame:
    """FN17, FN19: time left of a trip, and the radius of a landmark after some seconds."""
    q = F.col("l_quantity")
    rest = m.remaining_seconds(F.col("l_extendedprice"), F.col("l_tax") * 10, F.when(q > 5, q).otherwise(0.0))
    radius = m.landmark_radius(F.col("l_tax"), F.col("l_discount"), F.col("l_tax") / 1000, F.col("l_discount") / 100, q / 2)
    return table(spark, root, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(0.987654321 * F.sum(rest), 1).alias("left_over"), F.round(F.sum(radius), 2).alias("radius"))


_PATHS = [r"/(home|Users)/[A-Za-z0-9._-]+", r"C:\\Users\\[A-Za-z0-9._-]+"]
_TEAM = "(^|[^A-Za-z0-9])[A-Z0-9]{10}([^A-Za-z0-9]|$)"


@query(f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{_PATHS[0]}')) + len(regexp_extract_all(text, '{_PATHS[1]}')) AS BIGINT) AS paths, CAST(len(list_filter(regexp_extract_all(text, '[0-9]{{1,3}}\\.[0-9]{{4,}}'), lambda x: CAST(x AS DOUBLE) <= 180)) AS BIGINT) AS degrees, CAST(len(regexp_extract_all(text, '{_TEAM}')) AS BIGINT) AS teams
FROM documents WHERE text IS NOT NULL""")
def private_literals(spark: SparkSession, root: str) -> DataFrame:
    """FLT20: home folders, numbers that look like degrees, and ten-letter team ids in whole texts."""
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    degrees = F.filter(found(r"[0-9]{1,3}\.[0-9]{4,}"), lambda x: x.cast("double") <= 180)
    return table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", (F.size(found(_PATHS[0])) + F.size(found(_PATHS[1]))).cast("long").alias("paths"), F.size(degrees).cast("long").alias("degrees"), F.size(found(_TEAM)).cast("long").alias("teams"))


@query("""
WITH p AS (SELECT o_orderkey, (o_orderkey % 120) * 100.0 + o_custkey % 20 AS x, (o_orderkey // 120) * 100.0 + o_custkey % 17 AS y, o_orderpriority AS p, o_custkey FROM orders),
e AS (SELECT x, y FROM p QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT o_orderkey FROM p WHERE EXISTS (SELECT 1 FROM e WHERE sqrt(power(p.x - e.x, 2) + power(p.y - e.y, 2)) <= 300)""")
def near_drive_ends(spark: SparkSession, root: str) -> DataFrame:
    """JOI14: places within 300 metres of the end of a drive, by cells in place of a cross join."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = table(spark, root, "orders").select(k, c, "o_orderpriority", ((k % 120) * 100.0 + c % 20).alias("x"), (F.floor(k / 120) * 100.0 + c % 17).alias("y"))
    ends = p.groupBy("o_custkey").agg(F.max_by(F.struct("x", "y"), "o_orderkey").alias("e")).select("e.x", "e.y")
    return s.within(p, ends, 300).select("o_orderkey")


@query("""
SELECT CAST(user_id AS VARCHAR) AS drive, CASE WHEN user_id % 6 NOT IN (2, 3, 4) THEN 'version' WHEN user_id % 5 = 0 THEN 'snapshot' WHEN user_id % 7 = 0 THEN 'map' END AS reason FROM (SELECT DISTINCT user_id FROM events)""")
def compatible_headers(spark: SparkSession, root: str) -> DataFrame:
    """SRC03, FLT14: which recordings fit a graph."""
    u = F.col("user_id")
    header = F.struct((u % 6).alias("version"), F.when(u % 5 != 0, "s1").alias("snapshot"), F.when(u % 7 == 0, "h0").otherwise("h1").alias("mapHash"))
    rows = table(spark, root, "events").select(u.cast("string").alias("drive"), F.when(F.col("event_type") == "view", "sample").otherwise("header").alias("kind"), F.col("event_id").alias("sequence"), header.alias("header"))
    known = r.compatible(r.headers(rows), "s1", "h1")
    # A drive without a header row of its own has the columns of its events.
    return rows.select("drive", "header.*").distinct().join(known.select("drive"), "drive", "left_anti").transform(lambda d: r.compatible(d, "s1", "h1")).unionByName(known)


@query("""
WITH RECURSIVE h AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 <> 0 THEN user_id - 1 END AS parent FROM events), c AS (SELECT user_id AS drive, user_id AS ancestor, 0 AS step FROM h UNION ALL SELECT c.drive, h.parent, step + 1 FROM c JOIN h ON h.user_id = c.ancestor WHERE h.parent IS NOT NULL AND step < 8)
SELECT CAST(drive AS VARCHAR) AS drive, CAST(ancestor AS VARCHAR) AS ancestor, step FROM c""")
def recording_chain(spark: SparkSession, root: str) -> DataFrame:
    """SRC18: every recording with those that it goes on from."""
    u = F.col("user_id")
    heads = table(spark, root, "events").select(u.cast("string").alias("drive"), F.when(u % 4 != 0, F.concat((u - 1).cast("string"), F.lit(".jsonl.gz"))).alias("previousRecording")).distinct()
    return r.previous_chain(heads)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(event_id) % 2 = 0)")
def current_sessions(spark: SparkSession, root: str) -> DataFrame:
    """STR19: the live rows of sessions that are still current."""
    e = table(spark, root, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{root}/events*.parquet").select("event_id", "user_id")
    current = e.groupBy("user_id").agg(F.max("event_id").alias("last")).filter("last % 2 = 0")
    return live.run_to_end(live.current_session(stream, current, "user_id"), r.scratch(spark)).select("event_id", "user_id")


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), k AS (SELECT list_transform(range(-6, 7), lambda d: exp(-0.5 * power(d / 1.5, 2))) AS w)
SELECT vec_id, round(list_sum(list_transform(range(-6, 7), lambda d: v[greatest(1, least(len(v), 10 + d))] * w[d + 7])) / list_sum(w), 6) AS blurred, round(v[20] * (0.5 - 0.5 * cos(2 * pi() * 19 / (len(v) - 1))), 6) AS windowed,
  round(list_sum(list_transform(range(-6, 7), lambda d: v[greatest(1, least(len(v), 1 + d))] * w[d + 7])) / list_sum(w), 6) AS edge FROM e, k""")
def smoothed(spark: SparkSession, root: str) -> DataFrame:
    """FN10: Gaussian blur and Hann window of every vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, root, "embeddings").select("vec_id", signal.gaussian_blur(v, 1.5).alias("b"), signal.hann(v).alias("h"))
    return e.select("vec_id", F.round(F.col("b")[9], 6).alias("blurred"), F.round(F.col("h")[19], 6).alias("windowed"), F.round(F.col("b")[0], 6).alias("edge"))


@query("""
SELECT user_id, round(quantile_cont(e, 0.95), 4) AS p95, max(e) AS worst, count(*) AS n, max_by(e, event_id) AS last, count(*) FILTER (event_type = 'click') AS accepted, count(*) FILTER (event_type = 'view') AS detected,
  min_by(event_type, event_id) FILTER (event_type = 'error') AS failure, round(avg(CASE WHEN e <= 30 THEN 1 ELSE 0 END), 6) AS covered FROM (SELECT *, abs(value - 20) AS e FROM events) GROUP BY 1""")
def drive_errors(spark: SparkSession, root: str) -> DataFrame:
    """AGG13 in full: percentile, worst and last error, coverage, turns by stage, first failure of each drive."""
    kind, e = F.col("event_type"), F.abs(F.col("value") - 20)
    stage = F.when(kind == "click", "accepted").when(kind == "view", "detected")
    out = a.error_summary(table(spark, root, "events"), ["user_id"], e, e <= 30, time=F.col("event_id"), stage=stage, failure=F.when(kind == "error", kind))
    return out.withColumn("p95", F.round("p95", 4)).withColumn("covered", F.round("covered", 6))


@query("""
SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def ordered_names(spark: SparkSession, root: str) -> DataFrame:
    """SET07: distinct names in the order in which they come."""
    turns = table(spark, root, "conversations").filter("role IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.col("t.role")), ",").alias("roles"))


@query("""
SELECT host, page_id FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 12""")
def suggestions(spark: SparkSession, root: str) -> DataFrame:
    """TOP11: the first twelve of each source, in its own order."""
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return o.last_n(table(spark, root, "pages").select(host.alias("host"), "page_id"), "host", [F.asc("page_id")], 12).select("host", "page_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view') AND NOT (event_type = 'view' AND value < 5)")
def listed_events(spark: SparkSession, root: str) -> DataFrame:
    """FLT21: runs of the kinds asked for, without events that are no more than detected."""
    kept = table(spark, root, "events").filter(F.col("event_type").isin("click", "view"))
    return kept.filter(~((F.col("event_type") == "view") & (F.col("value") < 5))).select("event_id", "user_id", "event_type")
