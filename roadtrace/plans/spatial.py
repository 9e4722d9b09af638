"""Spatial queries: embeddings' first two values, times a thousand, are points of a plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.functions import geometry as g
from roadtrace.operators import spatial as s
from roadtrace.plans.registry import query
from roadtrace.sources.tables import table

_POINTS = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y FROM embeddings)"


def points(spark: SparkSession, root: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, root, "embeddings").select("vec_id", "label", (F.get(e, F.lit(0)).cast("double") * 1000).alias("x"), (F.get(e, F.lit(1)).cast("double") * 1000).alias("y"))


@query(f"""
WITH {_POINTS}, a AS (SELECT * FROM p WHERE vec_id % 2 = 0), b AS (SELECT * FROM p WHERE vec_id % 2 = 1)
SELECT a.vec_id, b.vec_id AS road, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 4) AS distance FROM a JOIN b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 40
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.vec_id) = 1""")
def nearest_grid(spark: SparkSession, root: str) -> DataFrame:
    """JOI05, JOI24, SET04: nearest neighbour over a grid; even ids snap to odd ones."""
    p = points(spark, root)
    near = s.nearest(p.filter("vec_id % 2 = 0"), p.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "road"), "vec_id", "road", 40, 20)
    return near.select("vec_id", "road", F.round("distance", 4).alias("distance"))


@query(f"WITH {_POINTS} SELECT vec_id FROM p WHERE label <> 0 AND EXISTS (SELECT 1 FROM p r WHERE r.label = 0 AND sqrt(power(p.x - r.x, 2) + power(p.y - r.y, 2)) <= 15)")
def within_buffer(spark: SparkSession, root: str) -> DataFrame:
    """JOI08: points within a buffer of others."""
    p = points(spark, root)
    return s.within(p.filter("label <> 0"), p.filter("label = 0"), 15).select("vec_id")


@query(f"""
WITH {_POINTS} SELECT vec_id FROM p WHERE (y BETWEEN -50 AND 50 AND x BETWEEN -50 AND 50) OR power(x - 100, 2) + power(y - 100, 2) <= 3600
  OR EXISTS (SELECT 1 FROM p r WHERE r.label = 0 AND sqrt(power(p.x - r.x, 2) + power(p.y - r.y, 2)) <= 15)""")
def corridor_membership(spark: SparkSession, root: str) -> DataFrame:
    """FLT04, FLT12: box, circle or route buffer."""
    p = points(spark, root)
    return s.corridor(p, [(-50, -50, 50, 50)], [(100, 100, 60)], p.filter("label = 0"), 15).select("vec_id")


@query(f"""
WITH RECURSIVE {_POINTS}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 25),
reach AS (SELECT vec_id AS root, vec_id AS node FROM p UNION SELECT root, b FROM reach JOIN l ON l.a = reach.node)
SELECT root AS vec_id, min(node) AS cluster FROM reach GROUP BY 1""")
def components(spark: SparkSession, root: str) -> DataFrame:
    """JOI09, AGG16: clusters of one label by proximity."""
    return s.clusters(points(spark, root), "vec_id", "label", 25).select("vec_id", "cluster")


_LONLAT = "30.52 + (l_partkey % 1000 - 500) / 2000.0 AS lon, 50.45 + (l_suppkey % 100 - 50) / 500.0 AS lat"


def _lonlat(spark: SparkSession, root: str) -> DataFrame:
    l = table(spark, root, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return l.select("l_partkey", "l_suppkey", (F.lit(30.52) + (F.col("l_partkey") % 1000 - 500) / 2000.0).alias("lon"), (F.lit(50.45) + (F.col("l_suppkey") % 100 - 50) / 500.0).alias("lat"))


@query(f"""
SELECT l_partkey, l_suppkey, round((lon - 30.52) * 111320 * cos(radians(50.45)), 3) AS x, round((lat - 50.45) * 111320, 3) AS y FROM (SELECT DISTINCT l_partkey, l_suppkey, {_LONLAT} FROM lineitem)""")
def project_equirect(spark: SparkSession, root: str) -> DataFrame:
    """FN01, FN03."""
    x, y = g.project_equirect(F.col("lon"), F.col("lat"), 30.52, 50.45)
    return _lonlat(spark, root).select("l_partkey", "l_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""
SELECT l_partkey, l_suppkey, round(k * cos(radians(lat)) * sin(radians(lon - 30.52)), 3) AS x, round(k * (cos(radians(50.45)) * sin(radians(lat)) - sin(radians(50.45)) * cos(radians(lat)) * cos(radians(lon - 30.52))), 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM (SELECT *, 2 * (111320 * 180 / pi()) / (1 + sin(radians(50.45)) * sin(radians(lat)) + cos(radians(50.45)) * cos(radians(lat)) * cos(radians(lon - 30.52))) AS k FROM (SELECT DISTINCT l_partkey, l_suppkey, {_LONLAT} FROM lineitem))""")
def project_stereo_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """FN02: to the plane and back."""
    x, y = g.project_stereo(F.col("lon"), F.col("lat"), 30.52, 50.45)
    there = _lonlat(spark, root).withColumns({"x": x, "y": y})
    lon, lat = g.unproject_stereo(F.col("x"), F.col("y"), 30.52, 50.45)
    return there.select("l_partkey", "l_suppkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.get(F.col("embedding"), 2 * i).cast("double") * 100).alias("x"), (F.get(F.col("embedding"), 2 * i + 1).cast("double") * 100).alias("y")))
    return table(spark, root, "embeddings").select("vec_id", pts.alias("points"))


_SEGS = """s AS (SELECT vec_id, i, CAST(embedding[2 * i - 1] AS DOUBLE) * 100 AS ax, CAST(embedding[2 * i] AS DOUBLE) * 100 AS ay, CAST(embedding[2 * i + 1] AS DOUBLE) * 100 AS bx, CAST(embedding[2 * i + 2] AS DOUBLE) * 100 AS by_
  FROM (SELECT vec_id, embedding, unnest(range(1, 32)) AS i FROM embeddings)),
c AS (SELECT *, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS len, sum(sqrt(power(bx - ax, 2) + power(by_ - ay, 2))) OVER (PARTITION BY vec_id ORDER BY i) AS til FROM s)"""


@query(f"WITH {_SEGS} SELECT vec_id, round(sum(len), 4) AS length FROM c GROUP BY 1")
def polyline_length(spark: SparkSession, root: str) -> DataFrame:
    """AGG23: an embedding's pairs as a line of 32 points."""
    return _lines(spark, root).select("vec_id", F.round(g.polyline_length(F.col("points")), 4).alias("length"))


@query(f"""
WITH {_SEGS}, h AS (SELECT * FROM c WHERE til >= 100 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY i) = 1)
SELECT vec_id, round(ax + (bx - ax) * (100 - (til - len)) / greatest(len, 0.001), 4) AS x, round(ay + (by_ - ay) * (100 - (til - len)) / greatest(len, 0.001), 4) AS y FROM h""")
def polyline_point(spark: SparkSession, root: str) -> DataFrame:
    """FN05: the point 100 along each line that is that long."""
    lines = _lines(spark, root).withColumn("p", g.point_at(F.col("points"), F.lit(100.0))).filter(g.polyline_length(F.col("points")) >= 100)
    return lines.select("vec_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(f"""
WITH {_SEGS}, e AS (SELECT *, greatest(0, least(1, (-ax * (bx - ax) - ay * (by_ - ay)) / greatest(power(bx - ax, 2) + power(by_ - ay, 2), 1e-9))) AS u FROM c),
f AS (SELECT *, sqrt(power(ax + (bx - ax) * u, 2) + power(ay + (by_ - ay) * u, 2)) AS error FROM e)
SELECT vec_id, round(error, 5) AS error, round(til - len + u * len, 4) AS along FROM f QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY error, i) = 1""")
def polyline_projection(spark: SparkSession, root: str) -> DataFrame:
    """FN07: where each line comes nearest to the origin."""
    on = _lines(spark, root).withColumn("on", g.project_on_polyline(F.col("points"), F.lit(0.0), F.lit(0.0)))
    return on.select("vec_id", F.round("on.error", 5).alias("error"), F.round("on.along", 4).alias("along"))


@query(f"""
WITH {_SEGS}, h AS (SELECT vec_id, i, atan2(bx - ax, by_ - ay) AS heading, lag(atan2(bx - ax, by_ - ay)) OVER (PARTITION BY vec_id ORDER BY i) AS was FROM c)
SELECT vec_id, round(sum(atan2(sin(heading - was), cos(heading - was))), 4) AS turned, round(max(abs(atan2(sin(heading - was), cos(heading - was)))), 5) AS sharpest, count(*) FILTER (abs(atan2(sin(heading - was), cos(heading - was))) >= radians(150)) AS reversals FROM h GROUP BY 1""")
def heading_unwrap(spark: SparkSession, root: str) -> DataFrame:
    """FN04, WIN20, GRF14: headings along a line, unwrapped."""
    heads = F.transform(g.segments(F.col("points")), lambda q: g.bearing(q["b"]["x"] - q["a"]["x"], q["b"]["y"] - q["a"]["y"]))
    lines = _lines(spark, root).withColumn("h", heads).select("vec_id", F.zip_with(F.slice("h", 2, 30), F.slice("h", 1, 30), g.angle_difference).alias("d"))
    return lines.select("vec_id", F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 4).alias("turned"), F.round(F.array_max(F.transform("d", F.abs)), 5).alias("sharpest"), F.size(F.filter("d", lambda x: F.abs(x) >= F.radians(F.lit(150)))).cast("long").alias("reversals"))


_OVERLAP = """
WITH w AS (SELECT k AS month, epoch_us(TIMESTAMP '1992-01-01') + k * 2592000000000 AS s, epoch_us(TIMESTAMP '1992-01-01') + (k + 1) * 2592000000000 AS e FROM range(0, 150) t(k)),
o AS (SELECT o_orderkey, o_totalprice, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + (10 + o_orderkey % 40) * 86400000000 AS e FROM orders)
SELECT month, count(*) AS n, round(sum(o_totalprice * ((least(o.e, w.e) - greatest(o.s, w.s)) / 86400000000.0)) / 1e6, 4) AS weighted FROM o JOIN w ON o.s < w.e AND o.e > w.s GROUP BY 1"""


@query(_OVERLAP)
def interval_overlap(spark: SparkSession, root: str) -> DataFrame:
    """JOI15: value times overlap with each interval; an interval is dealt to the cells it touches."""
    day, size = 86_400_000_000, 30 * 86_400_000_000
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    origin = 694_224_000_000_000
    o = table(spark, root, "orders").select("o_totalprice", start.alias("s"), (start + (10 + F.col("o_orderkey") % 40) * day).alias("e"))
    cells = o.withColumn("month", F.explode(F.sequence(F.floor((F.col("s") - origin) / size), F.floor((F.col("e") - 1 - origin) / size)))).filter("month BETWEEN 0 AND 149")
    part = F.least("e", F.lit(origin) + (F.col("month") + 1) * size) - F.greatest("s", F.lit(origin) + F.col("month") * size)
    return cells.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice") * (part / float(day))) / 1e6, 4).alias("weighted"))
