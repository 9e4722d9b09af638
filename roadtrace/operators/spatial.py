"""Spatial joins over planar points by grid cells: ordinary equi joins that Spark partitions, with a distance check.

A cell that is far denser than others is dealt to more tasks by adaptive execution, since both sides of each join
come straight from an exchange.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.functions.geometry import project_on_polyline, segments
from roadtrace.operators.components import components, stored


def cell(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col(x) / size), "cy": F.floor(F.col(y) / size)})


def around(df: DataFrame, size: float, rings: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    """A row for each cell within ``rings`` of the row's own."""
    steps = F.sequence(F.lit(-rings), F.lit(rings))
    spread = cell(df, size, x, y).withColumn("__dx", F.explode(steps)).withColumn("__dy", F.explode(steps))
    return spread.withColumns({"cx": F.col("cx") + F.col("__dx"), "cy": F.col("cy") + F.col("__dy")}).drop("__dx", "__dy")


def _distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.sqrt((F.col(ax) - F.col(bx)) ** 2 + (F.col(ay) - F.col(by)) ** 2)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, most: float, size: float) -> DataFrame:
    """JOI05: each left point's nearest right point nearer than ``most``, the smaller id on a tie."""
    rings = int(-(-most // size))
    l = around(left.select(left_id, F.col("x").alias("lx"), F.col("y").alias("ly")), size, rings, "lx", "ly")
    r = cell(right.select(right_id, F.col("x").alias("rx"), F.col("y").alias("ry")), size, "rx", "ry")
    met = l.join(r, ["cx", "cy"]).withColumn("d", _distance("lx", "ly", "rx", "ry")).filter(F.col("d") < most)
    best = met.groupBy(left_id).agg(F.min(F.struct("d", right_id)).alias("b"))
    return best.select(left_id, f"b.{right_id}", F.col("b.d").alias("distance"))


def _met(points: DataFrame, edges: DataFrame, most: float, size: float) -> DataFrame:
    """``points`` with cx, cy and (id, n, error, along) of every segment n of a road (id, points) that comes nearer than ``most``.

    A point stands in its own cell, a segment in all cells from which its box can be reached, so all that a point meets lies in one cell: what is
    grouped by cx, cy and the point needs no further shuffle.
    """
    length = lambda q: F.sqrt((q["b"]["x"] - q["a"]["x"]) ** 2 + (q["b"]["y"] - q["a"]["y"]) ** 2)
    begun = F.aggregate(segments(F.col("points")), F.array(F.lit(0.0)), lambda out, q: F.concat(out, F.array(F.element_at(out, -1) + length(q))))
    parts = edges.select("id", begun.alias("til"), F.posexplode(segments(F.col("points"))).alias("n", "q"))
    parts = parts.select("id", "n", F.get("til", F.col("n")).alias("base"), F.col("q.a.x").alias("ax"), F.col("q.a.y").alias("ay"), (F.col("q.b.x") - F.col("q.a.x")).alias("dx"), (F.col("q.b.y") - F.col("q.a.y")).alias("dy"))
    cells = lambda a, d: F.explode(F.sequence(F.floor((F.least(F.col(a), F.col(a) + F.col(d)) - most) / size), F.floor((F.greatest(F.col(a), F.col(a) + F.col(d)) + most) / size)))
    held = parts.withColumn("cx", cells("ax", "dx")).withColumn("cy", cells("ay", "dy"))
    met = cell(points, size).join(held, ["cx", "cy"])
    px, py = F.col("x"), F.col("y")
    square = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("ax")) * F.col("dx") + (py - F.col("ay")) * F.col("dy")) / F.greatest(square, F.lit(1e-9))))
    met = met.withColumn("share", share).withColumn("error", F.sqrt((F.col("ax") + F.col("dx") * F.col("share") - px) ** 2 + (F.col("ay") + F.col("dy") * F.col("share") - py) ** 2))
    return met.filter(F.col("error") < most).select("cx", "cy", *points.columns, "id", "n", "error", (F.col("base") + F.col("share") * F.sqrt(square)).alias("along"))


def roads_within(points: DataFrame, edges: DataFrame, point_id: str, most: float, size: float = 200.0) -> DataFrame:
    """JOI05: (``point_id``, id, error, along) of every road (id, points) whose line comes nearer than ``most`` to a point.

    A point has one place. The nearest road is the minimum of (error, id); on one road the first segment wins a tie.
    """
    near = _met(points.select(point_id, "x", "y"), edges, most, size).groupBy("cx", "cy", point_id, "id").agg(F.min(F.struct("error", "n", "along")).alias("b"))
    return near.select(point_id, "id", "b.error", "b.along")


def nearest_road(points: DataFrame, edges: DataFrame, point_id: str, most: float = 70.0, size: float = 200.0) -> DataFrame:
    """JOI05: each point's nearest road, the smaller id on a tie, with how far along it, and the number of roads it ``met``; a point is its id and place."""
    near = _met(points.select(point_id, "x", "y"), edges, most, size).groupBy("cx", "cy", point_id, "x", "y", "id").agg(F.min(F.struct("error", "n", "along")).alias("b"))
    best = near.groupBy("cx", "cy", point_id, "x", "y").agg(F.count("*").alias("met"), F.min(F.struct("b.error", "id", "b.along")).alias("b"))
    return best.select(point_id, "x", "y", "met", F.col("b.id").alias("edge"), "b.error", "b.along")


def _boxes(points: DataFrame, edges: DataFrame, key: str, margin: float) -> tuple[DataFrame, DataFrame]:
    """(``key``, w, e, s, n) of the points, ``margin`` wider, and (id, x0, x1, y0, y1) of physical roads, of two directions the smaller id."""
    low = points.groupBy(key).agg((F.min("x") - margin).alias("w"), (F.max("x") + margin).alias("e"), (F.min("y") - margin).alias("s"), (F.max("y") + margin).alias("n"))
    box_of = lambda c, f: f(F.transform("points", lambda q: q[c]))
    roads = edges.groupBy("way", F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.min(F.struct("id", "points")).alias("r")).select("r.id", "r.points")
    return low, roads.select("id", *(box_of(c, f).alias(n) for c, f, n in (("x", F.array_min, "x0"), ("x", F.array_max, "x1"), ("y", F.array_min, "y0"), ("y", F.array_max, "y1"))))


def nearby(points: DataFrame, edges: DataFrame, key: str, margin: float = 180.0, size: float = 500.0) -> DataFrame:
    """GRF13: (``key``, id) of physical roads whose box meets the box of a key's points, ``margin`` wider; of the two directions the
    smaller id stands. ``edges`` has (id, way, from, to, points); boxes meet by cells."""
    low, roads = _boxes(points, edges, key, margin)
    spread = lambda df, x0, x1, y0, y1: df.withColumn("cx", F.explode(F.sequence(F.floor(F.col(x0) / size), F.floor(F.col(x1) / size)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col(y0) / size), F.floor(F.col(y1) / size))))
    met = spread(low, "w", "e", "s", "n").join(spread(roads, "x0", "x1", "y0", "y1"), ["cx", "cy"]).filter("x1 >= w AND x0 <= e AND y1 >= s AND y0 <= n")
    return met.select(key, "id").distinct()


def _below(x: np.ndarray, y: np.ndarray, ids: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the number of points with x < qx and y < qy and the sum of their ids, by the ranks of y in a wavelet matrix over the order of x."""
    by = np.argsort(x, kind="stable")
    order = np.argsort(y, kind="stable")
    now = np.empty(len(x), np.int64)
    now[order] = np.arange(len(x))
    now, ids = now[by], ids[by]
    low, high, rank = np.zeros(len(qx), np.int64), np.searchsorted(x[by], qx), np.searchsorted(y[order], qy)
    out = np.zeros((2, len(qx)), np.int64)
    for bit in range(len(x).bit_length() - 1, -1, -1):
        zero = (now >> bit) & 1 == 0
        zeros, sums = np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0], np.cumsum(np.where(zero, ids, 0))])
        upper = (rank >> bit) & 1 == 1
        out += np.where(upper, [zeros[high] - zeros[low], sums[high] - sums[low]], 0)
        low, high = (np.where(upper, at - zeros[at] + zeros[-1], zeros[at]) for at in (low, high))
        now, ids = np.concatenate([now[zero], now[~zero]]), np.concatenate([ids[zero], ids[~zero]])
    return out


def _box_totals(key: tuple, boxes: pa.Table, roads: pa.Table) -> pa.Table:
    w, e, s, n = (boxes[c].to_numpy() for c in ("w", "e", "s", "n"))
    x0, x1, y0, y1, ids = (roads[c].to_numpy() for c in ("x0", "x1", "y0", "y1", "id"))
    everywhere = np.array([[len(ids)], [ids.sum()]])
    flat, wide = np.zeros(len(ids)), np.ones(len(w))
    # All roads without those west, east, south or north of the box, of which corners were taken off twice.
    out = everywhere - sum(_below(side, flat, ids, edge, wide) for side, edge in ((x1, w), (-x0, -e), (y1, s), (-y0, -n)))
    out = out + sum(_below(a, b, ids, p, q) for a, p in ((x1, w), (-x0, -e)) for b, q in ((y1, s), (-y0, -n)))
    return pa.table({"key": boxes["key"], "roads": out[0], "total": out[1]})


def nearby_totals(points: DataFrame, edges: DataFrame, key: str, margin: float = 180.0, size: float = 8000.0, together: int = 100_000) -> DataFrame:
    """GRF13: (``key``, roads, total) with the number of the roads of ``nearby`` and the sum of their ids, without a row for each.

    A road stands in the square cell where its box begins, of the first width among ``size`` and its doublings that is no less than the box. A task counts the
    roads of one cell, at most about ``together`` of them, for all boxes that may meet them; so a box is a row for each cell that it touches.
    """
    low, roads = _boxes(points, edges, key, margin)
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(size))
    roads = roads.withColumn("width", size * F.pow(F.lit(2.0), F.ceil(F.log2(extent / size))))
    roads = stored(roads.withColumns({"cx": F.floor(F.col("x0") / F.col("width")), "cy": F.floor(F.col("y0") / F.col("width"))}))
    cells = roads.groupBy("width", "cx", "cy").agg(F.ceil(F.count("*") / together).cast("int").alias("parts"))
    held = roads.join(cells, ["width", "cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    touched = low.crossJoin(cells.select(F.col("width").alias("wide")).distinct())
    for at, a, b in (("cx", "w", "e"), ("cy", "s", "n")):
        touched = touched.withColumn(at, F.explode(F.sequence(F.floor(F.col(a) / F.col("wide")) - 1, F.floor(F.col(b) / F.col("wide")))))
    asked = touched.withColumnRenamed("wide", "width").join(cells, ["width", "cx", "cy"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["width", "cx", "cy", "part"]
    boxes = asked.select(*by, F.col(key).alias("key"), "w", "e", "s", "n").groupBy(*by)
    kind = low.schema[key].dataType.simpleString()
    counted = boxes.cogroup(held.select(*by, "id", "x0", "x1", "y0", "y1").groupBy(*by)).applyInArrow(_box_totals, f"key {kind}, roads long, total long")
    return counted.groupBy(F.col("key").alias(key)).agg(F.sum("roads").alias("roads"), F.sum("total").alias("total")).filter("roads > 0")


def within(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """JOI08: the left points with a right point within ``most``."""
    r = around(right.select("x", "y"), most).select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("cx").alias("rcx"), F.col("cy").alias("rcy"))
    close = (F.col("cx") == F.col("rcx")) & (F.col("cy") == F.col("rcy")) & (_distance("x", "y", "rx", "ry") <= most)
    return cell(left, most).join(r, close, "left_semi").drop("cx", "cy")


def proximity_links(df: DataFrame, id_col: str, name: str, most: float) -> DataFrame:
    """JOI09, as links whose components are those of all pairs of one name within ``most``.

    Points of a cell half as wide as needed for its diagonal to fit in ``most`` are linked in a star through their smallest id. Pairs are
    made only between different cells of a neighbourhood, each pair of cells once, and of these one link for each pair of cells stays.
    """
    size = most / 2**0.5
    placed = cell(df.select(F.col(id_col).alias("id"), F.col(name).alias("name"), "x", "y"), size)
    heads = placed.groupBy("name", "cx", "cy").agg(F.min("id").alias("head"))
    inner = placed.join(heads, ["name", "cx", "cy"]).filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    # Half of the neighbours: cells above, or beside to the right.
    steps = [(dx, dy) for dx in range(-2, 3) for dy in range(0, 3) if dy > 0 or dx > 0]
    offsets = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps))).alias("o")
    other = placed.select(F.col("id").alias("oid"), "name", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("cx").alias("ocx"), F.col("cy").alias("ocy"), offsets)
    other = other.select("oid", "name", "ox", "oy", "ocx", "ocy", (F.col("ocx") - F.col("o.dx")).alias("cx"), (F.col("ocy") - F.col("o.dy")).alias("cy"))
    met = placed.join(other, ["name", "cx", "cy"]).filter(_distance("x", "y", "ox", "oy") <= most)
    outer = met.groupBy("name", "cx", "cy", "ocx", "ocy").agg(F.min(F.struct("id", "oid")).alias("l")).select(F.col("l.id").alias("a"), F.col("l.oid").alias("b"))
    return inner.union(outer)


def clusters(df: DataFrame, id_col: str, name: str, most: float) -> DataFrame:
    """AGG16: each point with the smallest id of its cluster of one name."""
    labels = components(proximity_links(df, id_col, name, most)).select(F.col("node").alias(id_col), F.col("label").alias("__label"))
    return df.join(labels, id_col, "left").withColumn("cluster", F.coalesce("__label", id_col)).drop("__label")


def box(x: Column, y: Column, south: float, west: float, north: float, east: float) -> Column:
    """FLT04: inclusive bounds."""
    return y.between(south, north) & x.between(west, east)


def corridor(df: DataFrame, boxes: list[tuple[float, float, float, float]], circles: list[tuple[float, float, float]], route: DataFrame, buffer: float) -> DataFrame:
    """FLT12: in any box, in any circle, or within ``buffer`` of a route's points."""
    conditions = [box(F.col("x"), F.col("y"), *b) for b in boxes] + [(F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2 <= r * r for cx, cy, r in circles]
    plain = reduce(Column.__or__, conditions, F.lit(False))
    return df.filter(plain).unionByName(within(df.filter(~plain), route, buffer))


def drag(moves: DataFrame, edges: DataFrame, turn_radius: float = 35.0, most: float = 80.0) -> DataFrame:
    """JOI06: (move, edge, error, along): where a point dragged from a road comes to lie.

    ``moves`` has (move, edge, x, y, from_x, from_y, node, node_distance); ``edges`` (id, start, end, points). Candidates are
    the move's own edge and, within ``turn_radius`` of a node, the edges at that node; moves over ``most`` give none.
    """
    short = moves.filter((F.col("x") - F.col("from_x")) ** 2 + (F.col("y") - F.col("from_y")) ** 2 <= most * most)
    own = short.select("move", "x", "y", F.col("edge").alias("id"))
    at = short.filter(F.col("node_distance") <= turn_radius).select("move", "x", "y", "node")
    ends = edges.select("id", F.explode(F.array_distinct(F.array("start", "end"))).alias("node"))
    near = own.unionByName(at.join(ends, "node").select("move", "x", "y", "id")).distinct()
    on = near.join(edges.select("id", "points"), "id").withColumn("p", project_on_polyline(F.col("points"), F.col("x"), F.col("y")))
    best = on.groupBy("move").agg(F.min(F.struct(F.col("p.error").alias("error"), F.col("id").alias("edge"), F.col("p.along").alias("along"))).alias("b"))
    return best.select("move", "b.edge", "b.error", "b.along")
