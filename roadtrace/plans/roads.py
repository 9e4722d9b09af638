"""Road queries on a grid network of road-like degree: every order is a crossing, streets join it to its neighbours.

Crossing k stands near (k % 120, k // 120) times a hundred metres, off by its customer. A street is a way of up to eleven crossings to the east
(way k // 10) or north; tags, one-way signs, access and turn restrictions follow from the ids, so everything grows with ``orders``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadtrace.functions import geometry as geo
from roadtrace.functions.motion import travel_seconds
from roadtrace.operators import features as f
from roadtrace.operators import graph as g
from roadtrace.operators import routing
from roadtrace.operators import spatial as s
from roadtrace.operators.components import stored
from roadtrace.plans.registry import query
from roadtrace.sources import maps
from roadtrace.sources.tables import table

WIDE = 120
NORTH = 10_000_000

_KINDS = "['residential', 'footway', 'primary', 'service', 'track', 'secondary', 'motorway', 'tertiary', 'living_street']"
_TAGS = f"""
nodes AS (SELECT o_orderkey AS id, (o_orderkey % {WIDE}) * 100.0 + o_custkey % 20 AS x, (o_orderkey // {WIDE}) * 100.0 + o_custkey % 17 AS y FROM orders),
held AS (SELECT id // 10 AS way, id % 10 AS pos, id AS node FROM nodes UNION ALL SELECT id // 10 - 1, 10, id FROM nodes WHERE id % 10 = 0 AND id % {WIDE} <> 0
  UNION ALL SELECT {NORTH} + (id % {WIDE}) * 100000 + (id // {WIDE}) // 10, (id // {WIDE}) % 10, id FROM nodes UNION ALL SELECT {NORTH} + (id % {WIDE}) * 100000 + (id // {WIDE}) // 10 - 1, 10, id FROM nodes WHERE (id // {WIDE}) % 10 = 0 AND id >= {WIDE * 10}),
wide AS (SELECT DISTINCT way FROM held),
tags AS (SELECT way, {_KINDS}[way % 9 + 1] AS highway, CASE WHEN way % 7 = 3 THEN 'yes' WHEN way % 7 = 5 THEN '-1' END AS oneway, CASE WHEN way % 13 = 4 THEN 'private' WHEN way % 13 = 6 THEN 'no' END AS access, CASE WHEN way % 26 = 6 THEN 'yes' END AS motorcar,
  CASE WHEN way % 31 = 8 THEN 'roundabout' END AS junction FROM wide),
admitted AS (SELECT * FROM tags WHERE ((highway IN ('residential', 'primary', 'service', 'secondary', 'motorway', 'tertiary', 'living_street')) OR (highway = 'track' AND way < 40)) AND coalesce(motorcar, access, 'yes') NOT IN ('no', 'private', 'agricultural', 'forestry')),
kept AS (SELECT * FROM admitted WHERE way % 50 <> 49),
rows AS (SELECT h.*, x, y FROM held h JOIN kept USING (way) JOIN nodes n ON n.id = h.node),
deg AS (SELECT node, count(DISTINCT way) AS degree FROM rows GROUP BY 1),
marked AS (SELECT r.*, degree > 1 OR pos = min(pos) OVER w OR pos = max(pos) OVER w AS cut, sum(len) OVER (PARTITION BY way ORDER BY pos) AS til, row_number() OVER (PARTITION BY way ORDER BY pos) AS n
  FROM (SELECT *, coalesce(sqrt(power(x - lag(x) OVER p, 2) + power(y - lag(y) OVER p, 2)), 0) AS len FROM rows WINDOW p AS (PARTITION BY way ORDER BY pos)) r JOIN deg USING (node) WINDOW w AS (PARTITION BY way)),
seg AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY pos) AS segment FROM (SELECT way, pos, node AS a, lead(node) OVER (PARTITION BY way ORDER BY pos) AS b, lead(til) OVER (PARTITION BY way ORDER BY pos) - til AS length, lead(n) OVER (PARTITION BY way ORDER BY pos) - n + 1 AS points FROM marked WHERE cut) WHERE b IS NOT NULL),
dirs AS (SELECT way, highway, unnest(CASE WHEN oneway = '-1' THEN [-1] WHEN oneway = 'yes' OR (oneway IS NULL AND (junction = 'roundabout' OR highway = 'motorway')) THEN [1] ELSE [1, -1] END) AS d FROM kept),
edges AS (SELECT row_number() OVER (ORDER BY way, segment, d DESC) - 1 AS id, way, highway AS kind, CASE WHEN d = 1 THEN a ELSE b END AS "from", CASE WHEN d = 1 THEN b ELSE a END AS "to", length, points FROM seg JOIN dirs USING (way))"""

_RULE_ROWS = f"""
rel AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'no_left_turn' WHEN o_orderkey % 5 = 1 THEN 'only_straight_on' WHEN o_orderkey % 5 = 2 THEN 'give_way' END AS rule FROM orders),
rules AS (SELECT k AS via, k // 10 AS from_way, CASE WHEN k % 17 = 0 THEN k // 10 ELSE {NORTH} + (k % {WIDE}) * 100000 + (k // {WIDE}) // 10 END AS to_way, rule = 'only_straight_on' AS "only", k % 13 <> 0 AND k % 11 <> 0 AS supported
  FROM rel WHERE rule IN ('no_left_turn', 'only_straight_on') AND k % 7 <> 0 AND k // 10 IN (SELECT way FROM admitted) AND (k % 17 <> 0))"""


def crossings(spark: SparkSession, root: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, root, "orders").select(k.alias("id"), ((k % WIDE) * 100.0 + c % 20).alias("x"), (F.floor(k / WIDE) * 100.0 + c % 17).alias("y"))


def streets(spark: SparkSession, root: str) -> DataFrame:
    """Ways as a map extract has them: (way, nodes, tags). Every fiftieth names a node that the extract lacks."""
    k = F.col("o_orderkey")
    row = F.floor(k / WIDE)
    east, north = F.floor(k / 10), F.lit(NORTH) + (k % WIDE) * 100_000 + F.floor(row / 10)
    place = lambda way, at: F.struct(way.cast("long").alias("way"), at.cast("int").alias("at"))
    own = F.array(
        place(east, k % 10), F.when((k % 10 == 0) & (k % WIDE != 0), place(east - 1, F.lit(10))), place(north, row % 10), F.when((row % 10 == 0) & (row > 0), place(north - 1, F.lit(10)))
    )
    held = table(spark, root, "orders").select(k.alias("node"), F.explode(own).alias("p")).filter("p IS NOT NULL")
    ways = held.groupBy("p.way").agg(F.transform(F.sort_array(F.collect_list(F.struct("p.at", "node"))), lambda q: q["node"]).alias("nodes"))
    w = F.col("way")
    kinds = F.array(*map(F.lit, ("residential", "footway", "primary", "service", "track", "secondary", "motorway", "tertiary", "living_street")))
    tag = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    listed = F.array(
        tag("highway", F.get(kinds, (w % 9).cast("int"))), tag("oneway", F.when(w % 7 == 3, "yes").when(w % 7 == 5, "-1")), tag("access", F.when(w % 13 == 4, "private").when(w % 13 == 6, "no")),
        tag("motorcar", F.when(w % 26 == 6, "yes")), tag("junction", F.when(w % 31 == 8, "roundabout")),
    )
    tags = F.map_from_entries(F.filter(listed, lambda t: t["value"].isNotNull()))
    return ways.select("way", F.when(w % 50 == 49, F.concat("nodes", F.array(F.lit(-1).cast("long")))).otherwise(F.col("nodes")).alias("nodes"), tags.alias("tags"))


def kept_streets(spark: SparkSession, root: str) -> DataFrame:
    track = (F.col("tags")["highway"] == "track") & (F.col("way") < 40)
    return streets(spark, root).filter(g.drivable(F.col("tags"), track))


def road_edges(spark: SparkSession, root: str) -> DataFrame:
    """(id, way, kind, from, to, points, length) of the directed graph."""
    edges = g.split_ways(kept_streets(spark, root), crossings(spark, root))
    return edges.select("id", "way", F.col("tags")["highway"].alias("kind"), "from", "to", "points", geo.polyline_length(F.col("points")).alias("length"))


def relations(spark: SparkSession, root: str) -> DataFrame:
    """Turn restrictions as a map extract has them: at every crossing from the street eastward to the one northward."""
    k = F.col("o_orderkey")
    member = lambda role, kind, ref: F.struct(F.lit(kind).alias("type"), ref.cast("long").alias("ref"), F.lit(role).alias("role"))
    east, north = F.floor(k / 10), F.lit(NORTH) + (k % WIDE) * 100_000 + F.floor(F.floor(k / WIDE) / 10)
    members = F.array(member("from", "way", east), member("via", "node", k), member("to", "way", F.when(k % 17 == 0, east).otherwise(north)))
    members = F.when(k % 13 == 0, F.concat(members, F.array(member("via", "node", k + 1)))).otherwise(members)
    rule = F.when(k % 5 == 0, "no_left_turn").when(k % 5 == 1, "only_straight_on").when(k % 5 == 2, "give_way")
    listed = F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in (("restriction", rule), ("except", F.when(k % 7 == 0, "bus;motorcar")), ("restriction:conditional", F.when(k % 11 == 0, "no_left_turn @ (Mo)")))))
    return table(spark, root, "orders").select(F.map_from_entries(F.filter(listed, lambda t: t["value"].isNotNull())).alias("tags"), members.alias("members"))


def legal(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The graph's edges and its legal turns, both cut off from their lineage, since searches read them often."""
    edges = stored(road_edges(spark, root))
    rules = g.restrictions(relations(spark, root), kept_streets(spark, root)).filter("supported").select("via", "from_way", "to_way", "only").distinct()
    return edges, stored(g.successors(edges, rules))


_TURNS = """
turns AS (SELECT a.id AS edge, b.id AS next, a."to" AS via, a.way AS from_way, b.way AS to_way FROM edges a JOIN edges b ON a."to" = b."from" WHERE NOT (a.way = b.way AND b."to" = a."from")),
legal AS (SELECT edge, next FROM turns t WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE supported AND NOT "only" AND r.via = t.via AND r.from_way = t.from_way AND r.to_way = t.to_way)
  AND NOT EXISTS (SELECT 1 FROM rules r WHERE supported AND "only" AND r.via = t.via AND r.from_way = t.from_way AND r.to_way <> t.to_way))"""


@query(f'WITH {_TAGS} SELECT id, way, kind, "from", "to", round(length, 4) AS length, points FROM edges')
def road_graph(spark: SparkSession, root: str) -> DataFrame:
    """GRF01, JOI01, FLT05, FLT07, FLT08: the directed graph of the streets that cars use."""
    return road_edges(spark, root).select("id", "way", "kind", "from", "to", F.round("length", 4).alias("length"), F.size("points").cast("long").alias("points"))


@query(f'WITH {_TAGS}, {_RULE_ROWS} SELECT via, from_way, to_way, "only", supported FROM rules')
def turn_restrictions(spark: SparkSession, root: str) -> DataFrame:
    """GRF02, FLT06: restriction relations as a table, unsupported ones marked."""
    return g.restrictions(relations(spark, root), kept_streets(spark, root)).select("via", "from_way", "to_way", "only", "supported")


@query(f"WITH {_TAGS}, {_RULE_ROWS}, {_TURNS} SELECT edge, next FROM legal")
def anti_restrictions(spark: SparkSession, root: str) -> DataFrame:
    """JOI02, GRF03: legal successors of every edge."""
    return legal(spark, root)[1]


@query(f'WITH {_TAGS} SELECT a.id, min(b.id) AS reverse FROM edges a JOIN edges b ON a.way = b.way AND a."from" = b."to" AND a."to" = b."from" AND abs(a.length - b.length) < 0.1 GROUP BY 1')
def reverse_edges(spark: SparkSession, root: str) -> DataFrame:
    """JOI04."""
    return g.reverse_edges(road_edges(spark, root))


@query(f"""
WITH RECURSIVE {_TAGS}, {_RULE_ROWS}, {_TURNS}, c AS (SELECT edge, next, length AS cost FROM legal JOIN edges ON edges.id = edge),
w AS (SELECT id AS start, id AS node, CAST(0 AS DOUBLE) AS cost, 0 AS d FROM edges UNION SELECT start, c.next, w.cost + c.cost, d + 1 FROM w JOIN c ON c.edge = w.node WHERE d < 4 AND w.cost + c.cost <= 350)
SELECT start, node, round(min(cost), 4) AS cost FROM w GROUP BY 1, 2""")
def bounded_reach(spark: SparkSession, root: str) -> DataFrame:
    """GRF08: from every edge, the cheapest connections of at most four turns and 350 metres."""
    edges, turns = legal(spark, root)
    first = F.element_at("points", 1)
    placed = edges.select("id", first["x"].alias("x"), first["y"].alias("y"), F.col("length").alias("cost"))
    return g.reach_near(placed, turns, 350, 4).select("start", "node", F.round("cost", 4).alias("cost"))


_ROUTES = """far AS (SELECT edge, max(next) AS next FROM legal GROUP BY 1),
req AS (SELECT a.edge AS request, a.edge AS start, c.next AS goal FROM far a JOIN far b ON b.edge = a.next JOIN far c ON c.edge = b.next WHERE a.edge % 100 = 0)"""


def _requests(turns: DataFrame) -> DataFrame:
    """The stated query set: a route from every hundredth edge to one three turns away."""
    far = turns.groupBy("edge").agg(F.max("next").alias("next"))
    hop = lambda df, old, new: df.join(far.select(F.col("edge").alias(old), F.col("next").alias(new)), old)
    starts = far.filter("edge % 100 = 0").select(F.col("edge").alias("start"), F.col("next").alias("a"))
    return hop(hop(starts, "a", "b"), "b", "goal").select(F.col("start").alias("request"), "start", "goal")


@query(f"""
WITH RECURSIVE {_TAGS}, {_RULE_ROWS}, {_TURNS}, {_ROUTES}, c AS (SELECT edge, next, length / (CASE kind WHEN 'motorway' THEN 100 WHEN 'primary' THEN 60 WHEN 'secondary' THEN 50 WHEN 'tertiary' THEN 45 WHEN 'living_street' THEN 15 WHEN 'service' THEN 15 WHEN 'track' THEN 12 ELSE 30 END / 3.6) AS cost FROM legal JOIN edges ON edges.id = edge),
w AS (SELECT request, goal, start AS edge, CAST(0 AS DOUBLE) AS cost, 0 AS d FROM req UNION ALL SELECT request, goal, next, w.cost + c.cost, d + 1 FROM w JOIN c USING (edge) WHERE edge <> goal AND w.cost + c.cost <= 20 AND d < 8)
SELECT request, round(min(cost), 4) AS cost FROM w WHERE edge = goal GROUP BY 1""")
def shortest_routes(spark: SparkSession, root: str) -> DataFrame:
    """GRF05, GRF06: fastest legal routes of up to twenty seconds for the stated requests against the whole graph."""
    edges, turns = legal(spark, root)
    timed = edges.select("id", travel_seconds(F.col("kind"), F.col("length")).alias("cost"))
    return routing.shortest(timed, turns, _requests(turns), most=20).select("request", F.round("cost", 4).alias("cost"))


@query(f"""
WITH {_TAGS}, {_RULE_ROWS}, {_TURNS}, far AS (SELECT edge, max(next) AS next FROM legal GROUP BY 1)
SELECT a.edge AS request, round(x.length + y.length - 10 + 5, 4) AS metres FROM far a JOIN far b ON b.edge = a.next JOIN far c ON c.edge = b.next JOIN edges x ON x.id = a.edge JOIN edges y ON y.id = b.edge""")
def route_metres(spark: SparkSession, root: str) -> DataFrame:
    """GRF11: metres of the three-edge routes from ten metres into every edge to five metres into the last."""
    edges, turns = legal(spark, root)
    far = turns.groupBy("edge").agg(F.max("next").alias("next")).checkpoint()
    hop = lambda df, old, new: df.join(far.select(F.col("edge").alias(old), F.col("next").alias(new)), old)
    three = hop(hop(far.select(F.col("edge").alias("request"), F.col("next").alias("a")), "a", "b"), "b", "c")
    routes = three.select("request", F.array("request", "a", "b").alias("route"), F.lit(10.0).alias("start_at"), F.lit(5.0).alias("goal_at"))
    return routing.clipped(routes, edges, "start_at", "goal_at").select("request", F.round("metres", 4).alias("metres"))


@query(f"""
WITH {_TAGS}, {_RULE_ROWS}, {_TURNS}, g AS (SELECT e.id, atan2(q.x - p.x, q.y - p.y) AS heading FROM edges e JOIN nodes p ON p.id = e."from" JOIN nodes q ON q.id = e."to")
SELECT edge, next, round(atan2(sin(b.heading - a.heading), cos(b.heading - a.heading)), 5) AS angle FROM legal JOIN g a ON a.id = edge JOIN g b ON b.id = next WHERE abs(atan2(sin(b.heading - a.heading), cos(b.heading - a.heading))) BETWEEN radians(45) AND radians(120)""")
def junction_candidates(spark: SparkSession, root: str) -> DataFrame:
    """JOI21: legal turns of 45 to 120 degrees."""
    edges, turns = legal(spark, root)
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    heading = geo.bearing(last["x"] - first["x"], last["y"] - first["y"])
    headed = edges.select("id", heading.alias("arrive"), heading.alias("leave"))
    return f.junctions(headed, turns, 0.7853981633974483, 2.0943951023931953).withColumn("angle", F.round("angle", 5))


_PROBES = "probes AS (SELECT l_orderkey * 10 + l_linenumber AS probe, (l_orderkey % 120) * 100.0 + l_quantity * 2 - 40 AS px, (l_orderkey // 120) * 100.0 + l_partkey % 90 - 40 AS py FROM lineitem)"


def _probes(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, root, "lineitem").select((k * 10 + F.col("l_linenumber")).alias("probe"), ((k % WIDE) * 100.0 + F.col("l_quantity") * 2 - 40).alias("x"), (F.floor(k / WIDE) * 100.0 + F.col("l_partkey") % 90 - 40).alias("y"))


_PARTS = """parts AS (SELECT e.id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM edges e JOIN nodes p ON p.id = e."from" JOIN nodes q ON q.id = e."to" WHERE points = 2)"""


@query(f"""
WITH {_TAGS}, {_PROBES}, {_PARTS}, m AS (SELECT DISTINCT probe, px, py, id, ax, ay, bx, by_ FROM probes JOIN parts ON abs(floor(px / 200) - floor(ax / 200)) <= 2 AND abs(floor(py / 200) - floor(ay / 200)) <= 2),
u AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / greatest(power(bx - ax, 2) + power(by_ - ay, 2), 1e-9))) AS t FROM m),
d AS (SELECT probe, px, py, id, sqrt(power(ax + (bx - ax) * t - px, 2) + power(ay + (by_ - ay) * t - py, 2)) AS error FROM u)
SELECT probe, round(px, 3) AS x, round(py, 3) AS y, count(*) AS met, round(min(error), 4) AS error FROM d WHERE error < 70 GROUP BY 1, 2, 3""")
def nearest_road(spark: SparkSession, root: str) -> DataFrame:
    """JOI05: every order line snapped to the nearest road within 70 metres by projection, with the number of roads there."""
    edges = road_edges(spark, root).filter(F.size("points") == 2).select("id", "points")
    best = s.nearest_road(_probes(spark, root), edges, "probe")
    return best.select("probe", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "met", F.round("error", 4).alias("error"))


@query(f"""
WITH {_TAGS}, b AS (SELECT o_custkey, min(x) - 180 AS w, max(x) + 180 AS e, min(y) - 180 AS s, max(y) + 180 AS n FROM (SELECT o_custkey, nodes.x, nodes.y FROM orders JOIN nodes ON nodes.id = o_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2) GROUP BY 1),
r AS (SELECT e.way, least(e."from", e."to") AS a, greatest(e."from", e."to") AS z, min(e.id) AS id, any_value(least(p.x, q.x)) AS x0, any_value(greatest(p.x, q.x)) AS x1, any_value(least(p.y, q.y)) AS y0, any_value(greatest(p.y, q.y)) AS y1 FROM edges e JOIN nodes p ON p.id = e."from" JOIN nodes q ON q.id = e."to" GROUP BY 1, 2, 3)
SELECT o_custkey, count(*) AS roads, CAST(sum(id) AS BIGINT) AS total FROM b JOIN r ON x1 >= w AND x0 <= e AND y1 >= s AND y0 <= n GROUP BY 1""")
def nearby_roads(spark: SparkSession, root: str) -> DataFrame:
    """GRF13, SET06: physical roads around each customer's first two crossings, by boxes 180 metres wider."""
    edges = road_edges(spark, root)
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    at = table(spark, root, "orders").withColumn("n", first).filter("n <= 2").select("o_custkey", F.col("o_orderkey").alias("id")).join(crossings(spark, root), "id")
    return s.nearby_totals(at, edges, "o_custkey", 180)


@query(f"""
WITH {_TAGS} SELECT count(*) AS roads, count(*) FILTER (length > 0) AS long, max(id) + 1 AS ids, count(DISTINCT kind) AS kinds, round(sum(length), 1) AS metres FROM edges""")
def graph_check(spark: SparkSession, root: str) -> DataFrame:
    """SRC05, SNK06, SRC07: the graph written as a bundle, loaded again with every check, and summed up."""
    folder = maps.scratch(spark)
    edges = road_edges(spark, root)
    # The grid grows northward with the table; latitudes come ever closer to 85 degrees, so that every crossing lies on the globe.
    lonlat = F.transform("points", lambda q: F.array(F.lit(30.0) + q["x"] / 1e5, F.lit(50.0) + q["y"] * 35 / (q["y"] + 35e5)))
    maps.write_bundle(edges.withColumn("points", lonlat), folder, name="grid", bounds=[49.0, 29.0, 86.0, 33.0], snapshot="2026-01-01")
    loaded = maps.load_graph(spark, folder, "grid")
    return loaded.agg(F.count("*").alias("roads"), F.count_if(F.col("length") > 0).alias("long"), (F.max("id") + 1).alias("ids"), F.count_distinct("kind").alias("kinds"), F.round(F.sum("length"), 1).alias("metres"))


@query(f"""
WITH {_TAGS}, {_PARTS} SELECT id, round(CASE WHEN len >= 60 THEN atan2(bx - ax, by_ - ay) END, 6) AS heading, CASE WHEN len >= 60 THEN 0.0 END AS curvature, round(ax + (bx - ax) * least(25, len) / len, 4) AS x
FROM (SELECT *, sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) AS len FROM parts)""")
def path_geometry(spark: SparkSession, root: str) -> DataFrame:
    """FN06, FN08: position, heading and curvature at given places of straight roads; null where the chord leaves the road."""
    edges = road_edges(spark, root).filter(F.size("points") == 2)
    p = F.col("points")
    curvature = geo.path_curvature(p, F.lit(30.0), 20.0)
    long = geo.polyline_length(p) >= 60
    return edges.select("id", F.round(F.when(long, geo.path_heading(p, F.lit(30.0), 40.0)), 6).alias("heading"), F.when(long, F.abs(F.round(curvature, 9))).alias("curvature"), F.round(geo.point_at(p, F.lit(25.0))["x"], 4).alias("x"))


@query(f"""
WITH {_TAGS}, {_PARTS}, moves AS (SELECT e.id AS move, (ax + bx) / 2 + (e.id % 60) AS mx, (ay + by_) / 2 + (e.id % 45) AS my, (ax + bx) / 2 AS fx, (ay + by_) / 2 AS fy, "from" AS node, CASE WHEN e.id % 3 = 0 THEN 20 ELSE 50 END AS node_distance, "from", "to" FROM edges e JOIN parts USING (id)),
ok AS (SELECT * FROM moves WHERE power(mx - fx, 2) + power(my - fy, 2) <= 6400),
cand AS (SELECT move, mx, my, move AS id FROM ok UNION SELECT move, mx, my, e.id FROM ok JOIN edges e ON node_distance <= 35 AND (e."from" = ok.node OR e."to" = ok.node) WHERE e.points = 2),
u AS (SELECT *, greatest(0, least(1, ((mx - ax) * (bx - ax) + (my - ay) * (by_ - ay)) / greatest(power(bx - ax, 2) + power(by_ - ay, 2), 1e-9))) AS t FROM cand JOIN parts USING (id))
SELECT move, round(min(sqrt(power(ax + (bx - ax) * t - mx, 2) + power(ay + (by_ - ay) * t - my, 2))), 4) AS error FROM u GROUP BY 1""")
def drag_snap(spark: SparkSession, root: str) -> DataFrame:
    """JOI06: the middle of every road dragged away, to where it comes to lie."""
    edges = road_edges(spark, root).filter(F.size("points") == 2)
    a, b, i = F.element_at("points", 1), F.element_at("points", -1), F.col("id")
    fx, fy = (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2
    moves = edges.select(i.alias("move"), i.alias("edge"), (fx + i % 60).alias("x"), (fy + i % 45).alias("y"), fx.alias("from_x"), fy.alias("from_y"), F.col("from").alias("node"), F.when(i % 3 == 0, 20).otherwise(50).alias("node_distance"))
    return s.drag(moves, edges.select("id", F.col("from").alias("start"), F.col("to").alias("end"), "points")).select("move", F.round("error", 4).alias("error"))

