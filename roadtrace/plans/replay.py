"""Replays, resampled signals and evidence over events and embeddings; one user is a drive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.functions import signal
from roadtrace.operators import features as f
from roadtrace.operators import graph as g
from roadtrace.operators import ordered as o
from roadtrace.plans.ordered import MINUTE, events
from roadtrace.plans.registry import query
from roadtrace.sources import recordings as r
from roadtrace.sources.tables import table

_US = "epoch_us(ts)"


@query(f"""
WITH s AS (SELECT user_id, event_id, value, {_US} AS t, lead({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS til FROM events),
i AS (SELECT user_id, event_id, t, til, value, coalesce(sum(value * (til - t)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s WHERE til > t),
g AS (SELECT user_id, h * 21600000000 AS t FROM (SELECT user_id, unnest(range(min(t) // 21600000000, max(t) // 21600000000 + 1)) AS h FROM s GROUP BY 1))
SELECT g.user_id, g.t AS at_us, round((base + value * (least(g.t, til) - i.t)) / 1e6, 2) AS integral FROM g ASOF LEFT JOIN i ON g.user_id = i.user_id AND g.t >= i.t""")
def integrated_at(spark: SparkSession, root: str) -> DataFrame:
    """JOI16: the integral of each user's values every six hours, each value holding until the next row."""
    e = events(spark, root).select("user_id", "event_id", "t", "value")
    before = o.with_previous(e, ["user_id"], ["t", "event_id"], ["t", "value", "event_id"], o.by_day("t")).filter("t > previous.t")
    steps = before.select("user_id", F.col("previous.event_id").alias("event_id"), F.col("t").alias("end"), F.col("previous.t").alias("t"), F.col("previous.value").alias("value"))
    span = e.groupBy("user_id").agg(F.floor(F.min("t") / (360 * MINUTE)).alias("a"), F.floor(F.max("t") / (360 * MINUTE)).alias("b"))
    grid = span.select("user_id", F.explode(F.transform(F.sequence("a", "b"), lambda k: k * F.lit(360 * MINUTE))).alias("t"))
    held = o.integrated(grid, steps, ["user_id"], "t", "value", o.by_day("t"), tie="event_id")
    return held.select("user_id", F.col("t").alias("at_us"), F.round(F.col("integral") / 1e6, 2).alias("integral"))


@query("""
WITH e AS (SELECT vec_id, len(embedding) AS n, unnest(embedding) :: DOUBLE * 6 AS v, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT vec_id, any_value(n) AS n, 8 + vec_id % 5 - (max(v) FILTER (i = n - 1) - max(v) FILTER (i = n // 2)) AS centre, max(v) FILTER (i = n // 2) AS vc FROM e GROUP BY vec_id),
s AS (SELECT vec_id, n, i, centre, centre + v - vc AS speed FROM e JOIN c USING (vec_id, n)),
ok AS (SELECT vec_id FROM s GROUP BY vec_id HAVING any_value(centre) >= 3 AND min(speed) >= 0.5 * any_value(centre) AND max(speed) - min(speed) >= 0.02 * any_value(centre)),
d AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY vec_id ORDER BY i), 0) AS driven FROM (SELECT *, (speed + lag(speed) OVER (PARTITION BY vec_id ORDER BY i)) / 200 AS step FROM s JOIN ok USING (vec_id))),
w AS (SELECT vec_id, n, max(driven) FILTER (i = n // 2) + (n // 4 - n // 2) * any_value(centre) / 100 AS a, max(driven) FILTER (i = n // 2) + (3 * n // 4 - n // 2) * any_value(centre) / 100 AS b FROM d GROUP BY 1, 2),
p AS (SELECT w.vec_id, q.k, max(i) FILTER (driven < q.target) AS i, max(driven) FILTER (driven < q.target) AS lo, min(driven) FILTER (driven >= q.target) AS hi, any_value(w.n) AS n, any_value(q.target) AS target
  FROM w, LATERAL (SELECT 0 AS k, a AS target UNION ALL SELECT 1, b) q JOIN d ON d.vec_id = w.vec_id GROUP BY 1, 2),
z AS (SELECT vec_id, k, round(CASE WHEN i IS NULL THEN 0 WHEN hi IS NULL THEN n - 1 ELSE i + (target - lo) / (hi - lo) END, 5) AS pos FROM p)
SELECT vec_id, max(pos) FILTER (k = 0) AS early, max(pos) FILTER (k = 1) AS late FROM z GROUP BY 1""")
def distance_resampled(spark: SparkSession, root: str) -> DataFrame:
    """WIN24: where a window resampled to equal distances reads at a quarter and three quarters."""
    v = F.transform("embedding", lambda x: x.cast("double") * 6)
    n = F.size("embedding")
    e = table(spark, root, "embeddings").select("vec_id", n.alias("n"), signal.distance_samples(v, (8 + F.col("vec_id") % 5).cast("double")).alias("p")).filter("p IS NOT NULL")
    at = lambda i: F.round(F.get("p", i.cast("int")), 5)
    return e.select("vec_id", at(F.floor(F.col("n") / 4)).alias("early"), at(F.floor(F.col("n") * 3 / 4)).alias("late"))


@query("""
WITH w AS (SELECT * FROM (VALUES ('click', 45.2), ('view', 41.3), ('purchase', 35.6), ('error', 31.8)) AS t(channel, weight)),
s AS (SELECT user_id, event_type AS channel, epoch_us(ts) // 3600000000 % 24 AS bin, sum(value * value) AS power FROM events GROUP BY 1, 2, 3),
n AS (SELECT user_id, channel, sum(power ** 0.2) AS total FROM s GROUP BY 1, 2)
SELECT user_id, bin, round(sum(power / (power ** 0.8 + 1e-20) * weight / sqrt(total * total + 1e-30)) / (45.2 + 41.3 + 35.6 + 31.8), 8) AS product FROM s JOIN n USING (user_id, channel) JOIN w USING (channel) GROUP BY 1, 2""")
def channel_products(spark: SparkSession, root: str) -> DataFrame:
    """JOI25: whitened products of each kind's daily pattern with itself, added up by weight."""
    e = events(spark, root).withColumn("bin", F.floor(F.col("t") / (60 * MINUTE)) % 24)
    spectra = e.groupBy("user_id", F.col("event_type").alias("channel"), "bin").agg(F.sum(F.col("value") * F.col("value")).alias("power"))
    kinds = dict(zip(("click", "view", "purchase", "error"), f.CHANNEL_WEIGHTS.values(), strict=False))
    return f.channel_products(spectra, "user_id", kinds).select("user_id", "bin", F.round("product", 8).alias("product"))


@query()
def credible_radii(spark: SparkSession, root: str) -> DataFrame:
    """AGG24: the radius about each user's mean that holds 95 % of the normals at its values."""
    e = events(spark, root)
    totals = e.groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("centre"), F.lit(2000.0).alias("length"))
    mixture = e.filter("value IS NOT NULL").join(totals.select("user_id", "n"), "user_id").select("user_id", (1 / F.col("n")).alias("weight"), F.col("value").alias("offset"), (F.col("event_id") % 9).cast("double").alias("variance"))
    return f.credible_radius(mixture, totals.filter("n > 0").select("user_id", "centre", "length"), "user_id").select("user_id", F.round("radius", 4).alias("radius"))


@query()
def vibration_levels(spark: SparkSession, root: str) -> DataFrame:
    """AGG26: level of the mid band of six axes in windows of 32 rows."""
    e = events(spark, root)
    axes = {f"a{i}": F.col("value") * (1 + F.col("event_id") % k) for i, k in enumerate((1, 2, 3, 5, 7, 11))}
    return f.vibration_level(e.select("user_id", "event_id", *(c.alias(n) for n, c in axes.items())), "user_id", "event_id", list(axes), size=32, hop=16, transform=64).withColumn("level", F.round("level", 6))


@query("""
WITH w AS (SELECT o_orderkey AS way, ['residential', 'footway', 'track', 'primary', NULL][o_orderkey % 5 + 1] AS highway, CASE WHEN o_orderkey % 3 = 0 THEN 'grade5' END AS tracktype, CASE WHEN o_orderkey % 4 = 0 THEN 'forest' END AS landuse,
  list_transform(range(1 + o_orderkey % 60), lambda j: {'lon': 24 + o_orderkey % 100 / 100.0 + j * 0.001, 'lat': 49.5 + o_orderkey % 37 / 100.0 + j * 0.0007, 'j': j}) AS points FROM orders),
s AS (SELECT *, len(points) AS n, greatest(1, len(points) // 20) AS every FROM w)
SELECT way FROM s WHERE (coalesce(highway IN ('residential', 'primary', 'track'), false) OR coalesce(landuse = 'forest', false))
  AND (coalesce(highway, '') <> 'track' OR (coalesce(tracktype, '') <> 'grade5' AND len(list_filter(points, lambda p: p.lat BETWEEN 49.6 AND 49.7 AND p.lon BETWEEN 24.2 AND 24.5)) > 0))
  AND len(list_filter(points, lambda p: p.lat BETWEEN 49.55 AND 49.8 AND p.lon BETWEEN 24.1 AND 24.8)) > 0
  AND len(list_filter(points, lambda p: (p.j % every = 0 OR p.j = n - 1) AND p.lat + p.lon > 74.0)) > 0""")
def collected_ways(spark: SparkSession, root: str) -> DataFrame:
    """FLT23: ways that an extract of a box and a corridor keeps."""
    k = F.col("o_orderkey")
    kind = F.get(F.array(*map(F.lit, ("residential", "footway", "track", "primary", None))), (k % 5).cast("int"))
    tags = F.create_map(F.lit("highway"), kind, F.lit("tracktype"), F.when(k % 3 == 0, "grade5"), F.lit("landuse"), F.when(k % 4 == 0, "forest"))
    point = lambda j: F.struct((24 + k % 100 / F.lit(100.0) + j * F.lit(0.001)).alias("lon"), (49.5 + k % 37 / F.lit(100.0) + j * F.lit(0.0007)).alias("lat"))
    ways = table(spark, root, "orders").select(k.alias("way"), tags.alias("tags"), F.transform(F.sequence(F.lit(0), (k % 60).cast("int")), point).alias("points"))
    wanted = g.collected(F.col("tags"), F.col("points"), [(49.6, 24.2, 49.7, 24.5)], clip=(49.55, 24.1, 49.8, 24.8), corridor=lambda p: p["lat"] + p["lon"] > 74.0)
    return ways.filter(wanted).select("way")


def _drives(spark: SparkSession, root: str) -> DataFrame:
    """Events as rows of recordings: each user's first is a header, the rest by their kind."""
    e = events(spark, root)
    heads = e.groupBy("user_id").agg(F.min("event_id").alias("head"))
    first = F.col("event_id") == F.col("head")
    kind = F.when(first, "header").when(F.col("event_type") == "click", "raw").when(F.col("event_type") == "view", "sample").when(F.col("event_type") == "purchase", "estimate").otherwise("event")
    time = F.col("t") / 1e6
    header = F.struct(F.lit(4).cast("long").alias("version"), F.concat(F.lit("map"), (F.col("user_id") % 2).cast("string")).alias("snapshot"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string"))).alias("mapHash"), F.create_map(F.lit("engine"), F.lit("1")).alias("metadata"))
    nothing = F.lit(None).cast("double")
    return e.join(heads, "user_id").select(
        F.col("user_id").alias("drive"), F.col("event_id").alias("sequence"), kind.alias("kind"), F.when(first, header).alias("header"), F.when(kind == "raw", F.struct(time.alias("time"))).alias("raw"), F.when(kind == "sample", F.struct(time.alias("time"))).alias("sample"),
        F.when(kind == "estimate", F.struct(time.alias("time"), F.col("value").alias("latitude"), nothing.alias("longitude"), F.col("value").alias("speed"), nothing.alias("heading"))).alias("estimate"), F.when(kind == "event", F.col("event_type")).alias("event"), time.alias("receivedUptime"), F.lit(None).cast("map<string,string>").alias("details"),
    )


_DRIVES = f"""
d AS (SELECT user_id AS drive, event_id AS sequence, {_US} / 1e6 AS time, value, event_id = min(event_id) OVER (PARTITION BY user_id) AS head, event_type FROM events),
k AS (SELECT *, CASE WHEN head THEN 'header' WHEN event_type = 'click' THEN 'raw' WHEN event_type = 'view' THEN 'sample' WHEN event_type = 'purchase' THEN 'estimate' ELSE 'event' END AS kind FROM d)"""


@query(f"""
WITH {_DRIVES}, c AS (SELECT k.drive, min(sequence) FILTER (kind = 'raw' AND time - origin > 604800) AS cut FROM k JOIN (SELECT drive, arg_min(time, sequence) FILTER (kind = 'raw') AS origin FROM k GROUP BY 1) USING (drive) GROUP BY 1)
SELECT drive, sequence, kind FROM k JOIN c USING (drive) WHERE kind IN ('header', 'raw', 'event') AND (cut IS NULL OR sequence < cut)""")
def raw_replay(spark: SparkSession, root: str) -> DataFrame:
    """SRC17: rows of a replay of raw frames that ends a week after the first."""
    return r.raw_replay(_drives(spark, root), 604_800).select("drive", "sequence", "kind")


@query("SELECT user_id AS drive, 'carried,2' AS notes FROM events GROUP BY 1")
def replay_headers(spark: SparkSession, root: str) -> DataFrame:
    """SNK07: headers that say how a replay was made."""
    rows = r.annotated(_drives(spark, root), {"engine": "2", "calibration": "carried"}).filter("kind = 'header'")
    return rows.select("drive", F.concat_ws(",", F.col("header.metadata")["calibration"], F.col("header.metadata")["engine"]).alias("notes"))


@query(f"""
WITH {_DRIVES}, z AS (SELECT drive, arg_min(time, sequence) AS zero FROM k WHERE kind = 'sample' AND drive % 2 = 1 AND drive % 3 IN (0, 1) GROUP BY 1)
SELECT drive, origin, count(*) AS n, count(event_type) FILTER (kind = 'event') AS events, round(max(time - zero), 3) AS last FROM k JOIN z USING (drive), (VALUES ('original', 0), ('current', 1)) AS o(origin, side)
WHERE kind IN ('estimate', 'event') AND (side = 0 OR sequence % 2 = 0) GROUP BY 1, 2""")
def beside_original(spark: SparkSession, root: str) -> DataFrame:
    """SRC19: recorded and replayed rows of the drives of one map, on a clock that begins with the drive."""
    rows = _drives(spark, root)
    both = r.beside(rows, rows.filter("sequence % 2 = 0"), "map1", "h1")
    return both.groupBy("drive", "origin").agg(F.count("*").alias("n"), F.count("event").alias("events"), F.round(F.max("time"), 3).alias("last"))
