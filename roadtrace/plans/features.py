"""Route features, matches, motion formulas, places and routing over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.functions import geometry as g
from roadtrace.functions import motion as m
from roadtrace.operators import features as f
from roadtrace.operators import places as p
from roadtrace.operators import routing
from roadtrace.operators.ordered import by_day, micros
from roadtrace.plans.registry import query
from roadtrace.plans.roads import _TAGS, road_edges
from roadtrace.plans.spatial import _POINTS, _SEGS, _lines, points
from roadtrace.sources.tables import table

_TURNS = f"""{_SEGS},
t AS (SELECT vec_id, i, til - len AS at, atan2(sin(h - p), cos(h - p)) AS delta FROM (SELECT vec_id, i, til, len, atan2(bx - ax, by_ - ay) AS h, lag(atan2(bx - ax, by_ - ay)) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM c) WHERE p IS NOT NULL),
a AS (SELECT *, CASE WHEN at - lag(at) OVER w <= 12 THEN 0 ELSE 1 END AS opens FROM t WHERE abs(delta) >= 0.6 WINDOW w AS (PARTITION BY vec_id ORDER BY at)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY vec_id ORDER BY at) AS bend FROM a),
s2 AS (SELECT *, sum(delta) OVER (PARTITION BY vec_id, bend ORDER BY at) AS run, sum(delta) OVER (PARTITION BY vec_id, bend) AS total FROM r),
bends AS (SELECT vec_id, bend, min(at) AS begin_at, max(at) AS end_at, sum(delta) AS angle, min(at) FILTER (abs(run) >= abs(total) / 2 - 1e-12) AS middle FROM s2 GROUP BY 1, 2 HAVING abs(sum(delta)) >= 0.35)"""
_TURNS = _TURNS.replace(" at,", ' "at",').replace("(at)", '("at")').replace("at - lag", '"at" - lag').replace("ORDER BY at", 'ORDER BY "at"')


def turns(spark: SparkSession, root: str) -> DataFrame:
    """(vec_id, at, delta): heading change and place of each corner of the embedding lines."""
    segs = F.transform(g.segments(F.col("points")), lambda q: F.struct(g.segment_length(q).alias("len"), g.bearing(q["b"]["x"] - q["a"]["x"], q["b"]["y"] - q["a"]["y"]).alias("h")))
    each = _lines(spark, root).select("vec_id", segs.alias("s")).select("vec_id", F.explode(F.expr("transform(sequence(1, size(s) - 1), i -> struct(aggregate(slice(s, 1, i), 0D, (t, q) -> t + q.len) AS at, s[i].h - s[i - 1].h AS raw))")).alias("c"))
    return each.select("vec_id", "c.at", F.atan2(F.sin("c.raw"), F.cos("c.raw")).alias("delta"))


def bends(spark: SparkSession, root: str) -> DataFrame:
    return f.bends(turns(spark, root), "vec_id", "at", "delta", 0.6, 12, 0.35)


@query(f"WITH {_TURNS} SELECT vec_id, CAST(bend AS BIGINT) AS bend, round(begin_at, 4) AS begin_at, round(end_at, 4) AS end_at, round(angle, 5) AS angle FROM bends")
def route_bends(spark: SparkSession, root: str) -> DataFrame:
    """WIN10: bends of the embedding lines."""
    return bends(spark, root).select("vec_id", F.col("bend").cast("long").alias("bend"), F.round("begin", 4).alias("begin_at"), F.round("end", 4).alias("end_at"), F.round("angle", 5).alias("angle"))


@query(f"""WITH {_TURNS} SELECT vec_id, round(begin_at, 4) AS begin_at, round(e2, 4) AS end_at, round(angle + a2, 5) AS angle FROM (
  SELECT *, lead(begin_at) OVER w AS b2, lead(end_at) OVER w AS e2, lead(angle) OVER w AS a2 FROM bends WINDOW w AS (PARTITION BY vec_id ORDER BY begin_at)) WHERE b2 - end_at BETWEEN 0 AND 60 AND abs(angle + a2) BETWEEN 1 AND 5""")
def bend_compounds(spark: SparkSession, root: str) -> DataFrame:
    """WIN11."""
    both = f.compounds(bends(spark, root), "vec_id", 60, 1, 5)
    return both.select("vec_id", F.round("begin", 4).alias("begin_at"), F.round("end", 4).alias("end_at"), F.round("angle", 5).alias("angle"))


@query(f"""WITH {_TURNS} SELECT vec_id, round(begin_at, 4) AS begin_at, round(begin_at - coalesce(lag(end_at) OVER w, 0), 4) AS before, round(coalesce(lead(begin_at) OVER w, 1000) - end_at, 4) AS after FROM bends WINDOW w AS (PARTITION BY vec_id ORDER BY begin_at)""")
def bend_straights(spark: SparkSession, root: str) -> DataFrame:
    """WIN13: with the routes' ends at 1,000."""
    out = f.straights(bends(spark, root), "vec_id", F.lit(1000.0))
    return out.select("vec_id", F.round("begin", 4).alias("begin_at"), F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


@query("""
WITH v AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS mass FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, mass FROM (SELECT *, lag(mass) OVER w AS a, lead(mass) OVER w AS b FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_partkey)) WHERE mass > coalesce(a, -1e300) AND mass >= coalesce(b, -1e300)""")
def density_peaks(spark: SparkSession, root: str) -> DataFrame:
    """WIN14: local maxima of a density."""
    v = table(spark, root, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("mass"))
    return f.peaks(v, "l_suppkey", "l_partkey", "mass")


@query("""
WITH RECURSIVE n AS (SELECT l_suppkey AS k, CAST(l_quantity AS BIGINT) AS c, sum(l_linenumber * l_linenumber) AS v FROM lineitem GROUP BY 1, 2),
d AS MATERIALIZED (SELECT a.k, a.c, CAST(coalesce(n.v, 0) AS DOUBLE) AS v FROM (SELECT k, unnest(range(1, 51)) AS c FROM n GROUP BY 1) a LEFT JOIN n USING (k, c)),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c) AS i FROM (SELECT *, coalesce(lag(v) OVER w, -1) AS l, coalesce(lead(v) OVER w, -1) AS r FROM d WINDOW w AS (PARTITION BY k ORDER BY c)) WHERE v > 0 AND v >= l AND v > r),
w AS (SELECT k, i, c AS kept, v AS kv, CAST(NULL AS BIGINT) AS opens FROM p WHERE i = 1 UNION ALL
  SELECT k, i, CASE WHEN low.v < 0.3 * least(kv, v) OR v > kv THEN c ELSE kept END, CASE WHEN low.v < 0.3 * least(kv, v) OR v > kv THEN v ELSE kv END, CASE WHEN low.v < 0.3 * least(kv, v) THEN low.c END
  FROM (SELECT p.k, p.i, p.c, p.v, w.kept, w.kv, min(struct_pack(v := d.v, c := d.c)) AS low FROM w JOIN p ON p.k = w.k AND p.i = w.i + 1 JOIN d ON d.k = w.k AND d.c BETWEEN w.kept AND p.c GROUP BY ALL)),
b AS (SELECT d.*, (SELECT count(*) FROM w WHERE w.k = d.k AND w.opens <= d.c) AS basin FROM d),
m AS (SELECT k, basin, min(c) AS "first", max(c) AS "last", sum(v) AS mass, sum(v * c * 5) / sum(v) AS mean FROM b GROUP BY 1, 2 HAVING sum(v) > 0),
s AS (SELECT m.*, (SELECT sum(b.v * power(b.c * 5 - m.mean, 2)) FROM b WHERE b.k = m.k AND b.basin = m.basin) AS spread, max(mass) OVER (PARTITION BY k) AS most FROM m)
SELECT k AS l_suppkey, "first", "last", round(mass * 5, 4) AS mass, round(mean, 5) AS mean, round(greatest(16, spread / mass + 25 / 12.0), 5) AS variance FROM s WHERE mass >= 1e-3 * most""")
def density_basins(spark: SparkSession, root: str) -> DataFrame:
    """WIN14: a density of each supplier's lines over quantities, split at its deep valleys."""
    n = table(spark, root, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("long").alias("cell")).agg(F.sum(F.col("l_linenumber") * F.col("l_linenumber")).cast("double").alias("v"))
    every = n.select("l_suppkey").distinct().withColumn("cell", F.explode(F.sequence(F.lit(1), F.lit(50)).cast("array<long>")))
    d = every.join(n, ["l_suppkey", "cell"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    out = f.basins(d, "l_suppkey", "cell", "v")
    return out.select("l_suppkey", "first", "last", F.round("mass", 4).alias("mass"), F.round("mean", 5).alias("mean"), F.round("variance", 5).alias("variance"))


@query("""
WITH v AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS mass FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, mass, CAST(row_number() OVER w AS BIGINT) AS place FROM v WINDOW w AS (PARTITION BY l_suppkey ORDER BY mass DESC, l_partkey) QUALIFY row_number() OVER w BETWEEN 2 AND 4""")
def alternative_groups(spark: SparkSession, root: str) -> DataFrame:
    """TOP01, TOP02: the second to fourth heaviest group."""
    v = table(spark, root, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("mass"))
    return f.top_groups(v, "l_suppkey", "l_partkey", "mass", 2, 4).withColumn("place", F.col("place").cast("long"))


@query("""
WITH t AS (SELECT o_custkey, o_orderkey AS id, o_totalprice / 1e4 - 25 AS angle, epoch_us(o_orderdate) / 8.64e10 AS middle FROM orders WHERE o_orderkey % 2 = 0),
x AS (SELECT o_custkey, o_orderkey AS id, o_totalprice / 1e4 - 25 AS angle, epoch_us(o_orderdate) / 8.64e10 AS middle, (o_orderkey % 5) * 50 AS half FROM orders WHERE o_orderkey % 2 = 1)
SELECT t.o_custkey, t.id AS turn, arg_min(x.id, struct_pack(d := abs(t.middle - x.middle), i := x.id)) AS feature, count(*) AS candidates FROM t JOIN x USING (o_custkey)
WHERE sign(t.angle) = sign(x.angle) AND abs(t.angle - x.angle) <= 12 AND abs(t.middle - x.middle) <= greatest(100, half) GROUP BY 1, 2""")
def turn_features(spark: SparkSession, root: str) -> DataFrame:
    """JOI19, JOI20: turns with the nearest feature that fits, and how many fit."""
    o = table(spark, root, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e4 - 25).alias("angle"), (micros("o_orderdate") / 8.64e10).alias("middle"))
    half = (F.col("id") % 5) * 50
    x = o.filter("id % 2 = 1").withColumns({"begin": F.col("middle") - half, "end": F.col("middle") + half})
    return f.matched(o.filter("id % 2 = 0"), x, "o_custkey", 12, 100)


@query("""
SELECT event_id, round(CASE WHEN abs(y) < 0.1 THEN 1 ELSE exp(-0.5 * least(9, power((value / 10 * y - 1.5) / (0.25 + 0.6 * abs(y)), 2))) END, 6) AS likelihood,
  round(0.1 * least(1, 1 / power(0.5 + value / 50, 2)), 6) AS pull, round(0.004 * value * value + 2 * sqrt(60 * value), 4) AS growth,
  round((0.4 + 0.6 * greatest(0, least(1, (value - 3) / 2.5))) * (1 - 0.55 * greatest(0, least(1, (value - 25) / 7.0))), 6) AS echo,
  round(1000 / (CASE event_type WHEN 'click' THEN 100 WHEN 'view' THEN 60 ELSE 30 END / 3.6), 4) AS seconds,
  CASE WHEN value > 100 THEN 'sensorGap' WHEN value > 80 THEN 'handling' WHEN abs(y) > 1.6 THEN 'handling' WHEN user_id % 9 = 0 THEN 'outsideCoverage' WHEN value * 10 > 350 THEN 'uncertain' END AS failure
FROM (SELECT *, (event_id % 41) / 20.0 - 1 AS y FROM events)""")
def motion_formulas(spark: SparkSession, root: str) -> DataFrame:
    """FN14-FN18, FN20, FLT18."""
    v, y = F.col("value"), (F.col("event_id") % 41) / 20.0 - 1
    kind = F.when(F.col("event_type") == "click", "motorway").when(F.col("event_type") == "view", "primary")
    return table(spark, root, "events").select(
        "event_id", F.round(m.turn_likelihood(v / 10, y, F.lit(1.5)), 6).alias("likelihood"), F.round(m.vibration_pull(0.5 + v / 50), 6).alias("pull"),
        F.round(m.uncertainty_growth(v, v), 4).alias("growth"), F.round(m.echo_weight(v), 6).alias("echo"), F.round(m.travel_seconds(kind, F.lit(1000)), 4).alias("seconds"),
        m.failure(v / 200, v * 1.2 / 80, y, v * 10, F.col("user_id") % 9 != 0).alias("failure"),
    )


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, value AS b FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, (1 - 1 / 120.0) * w.b + e.value / 120.0 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT event_id, round(b, 6) AS background FROM w""")
def exponential_background(spark: SparkSession, root: str) -> DataFrame:
    """WIN18."""
    e = table(spark, root, "events").select("user_id", "event_id", micros().alias("t"), "value")
    return f.background(e, "user_id", ["t", "event_id"], "value", 120, by_day("t")).select("event_id", F.round("background", 6).alias("background"))


@query("""
SELECT user_id, round(stddev_pop(d) / sqrt(2), 5) AS noise FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events) GROUP BY 1""")
def short_term_noise(spark: SparkSession, root: str) -> DataFrame:
    """AGG25: noise from first differences."""
    return f.short_term_noise(table(spark, root, "events"), "user_id", "event_id", "value").select("user_id", F.round("noise", 5).alias("noise"))


@query()
def power_spectrum(spark: SparkSession, root: str) -> DataFrame:
    """AGG25: Welch density of each event type's values; tested against numpy."""
    return f.spectrum(table(spark, root, "events"), "event_type", "event_id", "value", 128)


@query("""
WITH e AS (SELECT l_linenumber AS ratio, least(floor(l_quantity / 9), 5) AS band, avg(l_discount) AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT ratio, round(avg(mean), 6) AS evidence, count(*) FILTER (n >= 20) AS full_bands, CAST(sum(n) AS BIGINT) AS windows FROM e GROUP BY 1""")
def banded_evidence(spark: SparkSession, root: str) -> DataFrame:
    """AGG22."""
    out = f.banded_evidence(table(spark, root, "lineitem"), "l_linenumber", "l_quantity", "l_discount", 6, 9)
    return out.select(F.col("l_linenumber").alias("ratio"), F.round("evidence", 6).alias("evidence"), "full_bands", "windows")


@query(f"""
WITH {_POINTS}, s AS (SELECT *, CASE label WHEN 0 THEN 60 WHEN 1 THEN 30 ELSE 0 END AS bonus FROM p WHERE vec_id % 25 = 0), q AS (SELECT * FROM p WHERE vec_id % 25 <> 0),
d AS (SELECT q.vec_id, s.vec_id AS place, sqrt(power(q.x - s.x, 2) + power(q.y - s.y, 2)) - bonus AS score, abs(floor(q.x / 150) - floor(s.x / 150)) <= 1 AND abs(floor(q.y / 150) - floor(s.y / 150)) <= 1 AS near FROM q, s)
SELECT vec_id, place, round(score, 4) AS score FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN near THEN 0 ELSE 1 END, score, place) = 1""")
def nearest_settlement(spark: SparkSession, root: str) -> DataFrame:
    """JOI07: nearest place with bonuses by kind, over cells, else over all."""
    e = points(spark, root).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("kind"), "x", "y")
    near = p.nearest_settlement(e.filter("id % 25 <> 0"), e.filter("id % 25 = 0"), 150, {"0": 60.0, "1": 30.0})
    return near.select(F.col("id").alias("vec_id"), "place", F.round("score", 4).alias("score"))


@query("""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
w AS (SELECT vec_id, label, n, true AS kept, [struct_pack(x := x, y := y)] AS held FROM e WHERE n = 1 UNION ALL
  SELECT vec_id, label, n, free, CASE WHEN free THEN list_append(held, struct_pack(x := x, y := y)) ELSE held END FROM (SELECT e.*, w.held, len(list_filter(w.held, lambda q: power(q.x - e.x, 2) + power(q.y - e.y, 2) <= 900)) = 0 AS free FROM w JOIN e ON e.label = w.label AND e.n = w.n + 1))
SELECT vec_id, label FROM w WHERE kept""")
def duplicate_suppression(spark: SparkSession, root: str) -> DataFrame:
    """JOI10: suppression of near places of one kind in order, by rounds over cells."""
    return p.suppressed(points(spark, root), ["label"], ["vec_id"], 30).select("vec_id", "label")


@query("""
SELECT event_id, n AS "rows", round(v, 9) AS variance FROM (
  SELECT event_id, count(*) OVER w AS n, var_pop(value) OVER w AS v FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)) WHERE n >= 3 AND v <= 60""")
def settled_stops(spark: SparkSession, root: str) -> DataFrame:
    """FLT16, FLT17: calm stretches of the last day."""
    e = table(spark, root, "events").select("event_id", "user_id", micros().alias("t"), "value")
    return f.settled(e, "user_id", "t", "value", 86_400_000_000, 3, 60).select("event_id", "rows", F.round("variance", 9).alias("variance"))


@query("""
SELECT l_suppkey, count(*) AS "rows", min(l_orderkey) AS "begin", max(l_orderkey) AS "end", round(avg(l_tax), 6) AS mean_l_tax, round(stddev_pop(l_tax), 6) AS deviation_l_tax, round(avg(l_discount), 6) AS mean_l_discount, round(stddev_pop(l_discount), 6) AS deviation_l_discount FROM lineitem GROUP BY 1""")
def calibration_record(spark: SparkSession, root: str) -> DataFrame:
    """AGG21."""
    out = f.calibration_record(table(spark, root, "lineitem"), "l_suppkey", "l_orderkey", ["l_tax", "l_discount"])
    return out.select("l_suppkey", "rows", "begin", "end", *(F.round(c, 6).alias(c) for c in out.columns if c[:4] in ("mean", "devi")))


@query("""
SELECT l_orderkey, array_to_string(list_sort(list_filter([1, 2, 3, 4, 5, 6, 7], lambda c: NOT list_contains(r[-3:], c))), ',') AS open FROM (
  SELECT l_orderkey, list(CAST(l_linenumber AS INTEGER) ORDER BY l_linenumber) AS r FROM lineitem GROUP BY 1)""")
def unvisited_lines(spark: SparkSession, root: str) -> DataFrame:
    """SET05: candidates outside the last three of a route."""
    r = table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("r"))
    candidates = F.array(*map(F.lit, range(1, 8)))
    return r.select("l_orderkey", F.array_join(F.array_sort(f.unvisited(candidates, F.col("r"), 3)), ",").alias("open"))


@query(f"""WITH {_TAGS} SELECT way, least("from", "to") AS a, greatest("from", "to") AS b, count(*) AS directions FROM edges GROUP BY 1, 2, 3""")
def physical_roads(spark: SparkSession, root: str) -> DataFrame:
    """SET06: roads of the grid network regardless of direction."""
    return road_edges(spark, root).groupBy("way", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.count("*").alias("directions"))


@query()
def shortest_routes_whole(spark: SparkSession, root: str) -> DataFrame:
    """GRF05, GRF06 over the whole table under its own ids; leaving a node costs one to three; tested against brute force."""
    net = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("edge"), F.col("l_partkey").alias("next")).distinct()
    nodes = net.select(F.col("edge").alias("id")).union(net.select("next")).distinct().withColumn("cost", (1 + F.col("id") % 3).cast("double"))
    starts = net.filter("edge % 100 = 0").select(F.col("edge").alias("start")).distinct()
    pairs = starts.withColumn("goal", F.explode(F.array(*(F.lit(n).cast("long") for n in (20, 33, 47))))).withColumn("request", F.concat_ws("-", "start", "goal"))
    return routing.shortest(nodes, net, pairs, most=14).join(pairs, "request").select("start", "goal", "cost")


@query()
def junction_candidates_whole(spark: SparkSession, root: str) -> DataFrame:
    """JOI21 with every turn that the table holds; tested against brute force."""
    l = table(spark, root, "lineitem")
    e = l.select(F.col("l_suppkey").alias("id")).distinct().withColumns({"arrive": (F.col("id") * 37) % 63 / 10.0, "leave": (F.col("id") * 53) % 63 / 10.0})
    t = l.select(F.col("l_suppkey").alias("edge"), F.col("l_partkey").alias("next")).distinct()
    return f.junctions(e, t, 0.77, 2.11).withColumn("angle", F.round("angle", 5))


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value < 70 AS still, sum(CASE WHEN value < 70 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
n AS (SELECT *, row_number() OVER w AS n, coalesce(lag(t, 3) OVER w, first_value(t) OVER w) AS begun FROM e WHERE still WINDOW w AS (PARTITION BY user_id, island ORDER BY t, event_id))
SELECT user_id, begun AS "begin", t AS "end", least(n, 4) AS frames FROM n WHERE t - begun >= 36000000000 AND least(n, 4) >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) = 1""")
def calibration_gates(spark: SparkSession, root: str) -> DataFrame:
    """FLT16: of each user the first run of small values that lasts ten hours and three events, by its last four."""
    e = table(spark, root, "events").select("user_id", "event_id", micros("ts").alias("t"), "value")
    return f.calibration_intervals(e, "user_id", ["t", "event_id"], F.col("value") < 70, by_day("t"), span=36_000_000_000, frames=3, kept=4)
