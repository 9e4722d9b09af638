"""Directed road graphs: built from map extracts, restricted, contracted, searched.

Edges are rows (id, way, from, to, ...). Turn restrictions are rows (via, from_way, to_way, only).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.operators.components import shared_folder
from roadtrace.operators.ordered import running_sum

#: Road kinds that a car uses, and access values that keep it out (fixed values of the map format).
DRIVABLE = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service"]
NO_ACCESS = ["no", "private", "agricultural", "forestry"]


def drivable(tags: Column, extra: Column | None = None) -> Column:
    """FLT05, FLT07: a road kind (or ``extra``) whose first access tag admits cars."""
    access = F.coalesce(*(tags[name] for name in ("motorcar", "motor_vehicle", "vehicle", "access")), F.lit("yes"))
    kind = tags["highway"].isin(DRIVABLE)
    return F.coalesce(kind if extra is None else kind | extra, F.lit(False)) & ~access.isin(NO_ACCESS)


#: Areas that a map shows beside roads (fixed values of the map format).
AREAS = [("natural", "water"), ("waterway", "riverbank"), ("landuse", "forest"), ("landuse", "grass"), ("landuse", "recreation_ground"), ("leisure", "park")]


def collected(tags: Column, points: Column, focus: list[tuple[float, float, float, float]], *, clip: tuple[float, float, float, float] | None = None, corridor: Callable[[Column], Column] | None = None) -> Column:
    """FLT23: whether an extract keeps a way: a road or an area; a track only inside ``focus`` and below grade 5.

    Boxes are (south, west, north, east) and ``points`` structs of (lon, lat); one point within suffices. A ``corridor`` tests every
    n-th point, about twenty of them, and the last.
    """
    inside = lambda p, b: p["lat"].between(b[0], b[2]) & p["lon"].between(b[1], b[3])
    kind = F.coalesce(tags["highway"], F.lit(""))
    area = reduce(Column.__or__, (F.coalesce(tags[k] == v, F.lit(False)) for k, v in AREAS))
    focused = F.exists(points, lambda p: reduce(Column.__or__, (inside(p, b) for b in focus), F.lit(False)))
    kept = (kind.isin(DRIVABLE) | (kind == "track") | area) & ((kind != "track") | (focused & (F.coalesce(tags["tracktype"], F.lit("")) != "grade5")))
    if clip is not None:
        kept &= F.exists(points, lambda p: inside(p, clip))
    if corridor is not None:
        n = F.size(points)
        every = F.greatest(F.lit(1), F.floor(n / 20).cast("int"))
        kept &= F.exists(F.filter(points, lambda _, i: (i % every == 0) | (i == n - 1)), corridor)
    return F.coalesce(kept, F.lit(False))


def directions(tags: Column) -> Column:
    """FLT08: array of the directions (1, -1) in which a way is driven."""
    given = F.coalesce(tags["oneway"], F.lit(""))
    implied = (given == "") & ((F.coalesce(tags["junction"], F.lit("")) == "roundabout") | (F.coalesce(tags["highway"], F.lit("")) == "motorway"))
    return F.when(given == "-1", F.array(F.lit(-1))).when(implied | given.isin("yes", "1", "true"), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(-1)))


def split_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRF01: directed edges of ways (way, nodes, tags), cut at nodes that two ways share and at the ends.

    A way with an unknown node is dropped whole (JOI01). Ids are dense in the order of way, segment and direction; they come
    from per-way counts, so ways, not edges, are put in one order.
    """
    held = ways.select("way", F.posexplode("nodes").alias("at", "node"))
    places = nodes.select(F.col("id").alias("node"), "x", "y")
    broken = held.join(places, "node", "left_anti").select("way").distinct()
    whole = ways.join(broken, "way", "left_anti")
    placed = whole.select("way", F.posexplode("nodes").alias("at", "node")).join(places, "node")
    # Two ways share a node if its least and its greatest way differ.
    at_node = Window.partitionBy("node")
    marked = placed.select("way", "at", "node", "x", "y", (F.min("way").over(at_node) != F.max("way").over(at_node)).alias("shared"))
    rows = marked.groupBy("way").agg(F.sort_array(F.collect_list(F.struct("at", "node", "x", "y", "shared"))).alias("p"))
    rows = rows.join(whole.select("way", "tags", F.size("nodes").alias("size")), "way").filter(F.size("p") == F.col("size"))
    last = F.col("size") - 1
    cuts = F.filter(F.transform("p", lambda q, i: F.when(q["shared"] | (i == 0) | (i == last), i)), lambda i: i.isNotNull())
    rows = rows.select("way", "tags", "p", cuts.alias("cuts"), directions(F.col("tags")).alias("directions"))
    counts = rows.select("way", (F.greatest(F.size("cuts") - 1, F.lit(0)) * F.size("directions")).cast("long").alias("n"))
    summed = running_sum(counts.withColumn("all", F.lit(0)), ["all"], ["way"], F.col("n"), F.floor(F.col("way") / 100_000), "til")
    offsets = summed.select("way", (F.col("til") - F.col("n")).alias("base"))
    # A cut node ends one segment and begins the next.
    ends = F.transform(F.slice("cuts", F.lit(2), F.greatest(F.size("cuts") - 1, F.lit(0))), lambda end, i: F.struct((i + 1).alias("segment"), F.get("cuts", i).alias("first"), end.alias("last")))
    pieces = rows.select("way", "tags", "p", "directions", F.explode(ends).alias("s"))
    both = pieces.select("way", "tags", F.col("s.segment").alias("segment"), F.size("directions").alias("ways"), F.posexplode("directions").alias("turn", "direction"), F.slice("p", F.col("s.first") + 1, F.col("s.last") - F.col("s.first") + 1).alias("p"))
    points = F.when(F.col("direction") == 1, F.col("p")).otherwise(F.reverse("p"))
    edges = both.select("way", "segment", "direction", "tags", ((F.col("segment") - 1) * F.col("ways") + F.col("turn")).alias("place"), points.alias("p"))
    edges = edges.join(offsets, "way").withColumn("id", F.col("base") + F.col("place"))
    return edges.select("way", "segment", "direction", "tags", F.element_at("p", 1)["node"].alias("from"), F.element_at("p", -1)["node"].alias("to"), F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"), "id")


def restrictions(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """FLT06, GRF02: (via, from_way, to_way, only, supported) of restriction relations (tags, members)."""
    tags = F.col("tags")
    rule = F.coalesce(tags["restriction:motorcar"], tags["restriction"])
    rows = relations.withColumn("rule", rule).filter(F.col("rule").rlike("^(no|only)_"))
    rows = rows.filter(~F.arrays_overlap(F.split(F.coalesce(tags["except"], F.lit("")), ";"), F.array(F.lit("motorcar"), F.lit("motor_vehicle"))))
    member = lambda role, kind: F.transform(F.filter("members", lambda m: (m["role"] == role) & (m["type"] == kind)), lambda m: m["ref"])
    rows = rows.select("rule", member("via", "node").alias("vias"), member("from", "way").alias("froms"), member("to", "way").alias("tos"), F.exists(F.map_keys(tags), lambda k: k.contains("conditional")).alias("conditional"))
    rows = rows.withColumn("supported", (F.size("vias") == 1) & ~F.col("conditional"))
    each = rows.select("rule", "supported", F.get("vias", F.lit(0)).alias("via"), F.explode("froms").alias("from_way"), "tos").select("rule", "supported", "via", "from_way", F.explode("tos").alias("to_way"))
    kept = each.join(ways.select(F.col("way").alias("from_way")), "from_way", "left_semi").filter("from_way <> to_way")
    return kept.select("via", "from_way", "to_way", F.col("rule").startswith("only_").alias("only"), "supported")


def successors(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """JOI02, GRF03: legal (edge, next) pairs.

    Turning back at once is not legal; a forbidden turn is left out; of several mandatory turns all must be met.
    """
    # A road takes its restrictions along to the crossing, so that no turn is ever a row of a shuffle.
    told = rules.groupBy("via", "from_way").agg(F.collect_set(F.when(~F.col("only"), F.col("to_way"))).alias("banned"), F.min(F.when(F.col("only"), F.col("to_way"))).alias("must"), F.max(F.when(F.col("only"), F.col("to_way"))).alias("must_too"))
    a = edges.select(F.col("id").alias("edge"), F.col("way").alias("from_way"), F.col("from").alias("start"), F.col("to").alias("via")).join(told, ["via", "from_way"], "left")
    b = edges.select(F.col("id").alias("next"), F.col("way").alias("to_way"), F.col("from").alias("via"), F.col("to").alias("end"))
    turns = a.join(b, "via").filter(~((F.col("from_way") == F.col("to_way")) & (F.col("end") == F.col("start"))))
    free = F.col("banned").isNull() | ~F.array_contains("banned", F.col("to_way"))
    return turns.filter(free).filter("must IS NULL OR (must = to_way AND must_too = to_way)").select("edge", "next")


def mandatory_conflicts(rules: DataFrame) -> DataFrame:
    """JOI03: (via, from_way) with more than one mandatory target."""
    return rules.filter("only").groupBy("via", "from_way").agg(F.count_distinct("to_way").alias("targets")).filter("targets > 1")


def reverse_edges(edges: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """JOI04: each edge's first counterpart: same way, ends swapped, nearly the same length."""
    b = edges.select(F.col("id").alias("reverse"), F.col("way"), F.col("from").alias("to"), F.col("to").alias("from"), F.col("length").alias("other"))
    met = edges.join(b, ["way", "from", "to"]).filter(F.abs(F.col("length") - F.col("other")) < tolerance)
    return met.groupBy("id").agg(F.min("reverse").alias("reverse"))


def degrees(incidence: DataFrame, way: str, node: str) -> DataFrame:
    """AGG17: how many ways hold each node."""
    return incidence.select(way, node).distinct().groupBy(node).agg(F.count("*").alias("degree"))


def chains(links: DataFrame) -> DataFrame:
    """GRF04: (edge, chain, place) for continuations (edge, next); a continuation counts if it is the only one both ways.

    Predecessors are followed by pointer doubling, so a chain of n edges takes log2(n) joins. Edges of a cycle stay
    single.
    """
    shared_folder(links.sparkSession)
    one_out = links.groupBy("edge").agg(F.count("*").alias("n"), F.min("next").alias("next")).filter("n = 1").select("edge", "next")
    one_in = one_out.join(links.groupBy("next").agg(F.count("*").alias("m")).filter("m = 1").select("next"), "next")
    every = links.select("edge").union(links.select("next")).distinct()
    back = one_in.filter("edge <> next").select(F.col("next").alias("edge"), F.col("edge").alias("jump"))
    state = every.join(back, "edge", "left").select("edge", F.coalesce("jump", "edge").alias("jump"), F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("jump").isNull().alias("done")).checkpoint()
    total = state.count()
    reach = 1
    while reach < 2 * total and not state.filter("NOT done").isEmpty():
        far = state.select(F.col("edge").alias("jump"), F.col("jump").alias("far"), F.col("place").alias("more"), F.col("done").alias("ends"))
        state = state.join(far, "jump").select("edge", F.when(F.col("done"), F.col("jump")).otherwise(F.col("far")).alias("jump"), F.when(F.col("done"), F.col("place")).otherwise(F.col("place") + F.col("more")).alias("place"), (F.col("done") | F.col("ends")).alias("done")).checkpoint()
        reach *= 2
    return state.select("edge", F.when(F.col("done"), F.col("jump")).otherwise(F.col("edge")).alias("chain"), F.when(F.col("done"), F.col("place")).otherwise(F.lit(0)).alias("place"))


def reach(links: DataFrame, starts: DataFrame, cost: str, most: float, rounds: int) -> DataFrame:
    """GRF08: (start, node, cost) of the cheapest walks of at most ``rounds`` links and cost ``most`` from each start."""
    shared_folder(links.sparkSession)
    best = starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"))
    frontier = best
    for _ in range(rounds):
        step = frontier.join(links.select(F.col("edge").alias("node"), "next", F.col(cost).alias("step")), "node").select("start", F.col("next").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).filter(F.col("cost") <= most)
        step = step.groupBy("start", "node").agg(F.min("cost").alias("cost"))
        old = best.select("start", "node", F.col("cost").alias("old"))
        frontier = step.join(old, ["start", "node"], "left").filter("old IS NULL OR cost < old").select("start", "node", "cost").checkpoint()
        best = best.unionByName(frontier).groupBy("start", "node").agg(F.min("cost").alias("cost")).checkpoint()
    return best


def reach_near(edges: DataFrame, turns: DataFrame, most: float, rounds: int, size: float = 4000.0, together: int = 8192) -> DataFrame:
    """GRF08 on a plane: ``reach`` from every edge (id, x, y, cost), where no cost is less than the line from an edge's start to that of the next.

    So nothing within ``most`` lies farther than that from a start. A task holds the edges of a square cell and of a margin so wide, and walks from those that
    begin in the cell, at most ``together`` of them: connections are only written, never shuffled.
    """
    nexts = turns.groupBy("edge").agg(F.collect_list("next").alias("nexts"))
    cell = lambda dx=0, dy=0: F.struct(F.floor((F.col("x") + dx) / size).alias("x"), F.floor((F.col("y") + dy) / size).alias("y"))
    margin = most * (1 + 1e-9) + 1e-6
    steps = sorted({min(k * size, margin) * sign for k in range(1, int(margin / size) + 2) for sign in (-1, 1)} | {0.0})
    placed = edges.select(F.col("id").alias("edge"), "x", "y", "cost", cell().alias("home")).join(nexts, "edge", "left")
    parts = edges.groupBy(cell().alias("cell")).agg(F.ceil(F.count("*") / together).cast("int").alias("parts"))
    seen = F.array_distinct(F.array(*(cell(dx, dy) for dx in steps for dy in steps)))
    rows = placed.select("edge", "cost", "nexts", "home", F.explode(seen).alias("cell")).join(parts, "cell")
    mine = F.when(F.col("home") == F.col("cell"), F.pmod(F.xxhash64("edge"), "parts").cast("int"))
    rows = rows.select("edge", "cost", "nexts", "cell", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def walks(key: tuple, held: pa.Table) -> pa.Table:
        ids, cost = held["edge"].to_numpy(), held["cost"].to_numpy()
        order = np.argsort(ids)
        lists = held["nexts"].combine_chunks()
        counts = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        to = pc.list_flatten(lists).to_numpy()
        # Turns to edges outside the margin cost more than ``most``.
        at = np.searchsorted(ids[order], to).clip(0, len(ids) - 1)
        found = ids[order][at] == to
        owner = np.repeat(np.arange(len(ids)), counts)[found]
        to, begin = order[at][found], np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=len(ids)), out=begin[1:])
        mine = held["mine"].to_numpy(zero_copy_only=False)
        start = np.flatnonzero(mine == key[1].as_py())
        best = frontier = (start * len(ids) + start, np.zeros(len(start)))
        for _ in range(rounds):
            walk, node = np.divmod(frontier[0], len(ids))
            n = begin[node + 1] - begin[node]
            ends = np.cumsum(n)
            pick = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(begin[node], n)
            spent = np.repeat(frontier[1] + cost[node], n)
            near = spent <= most
            step = np.repeat(walk, n)[near] * len(ids) + to[pick][near], spent[near]
            states, spent = np.concatenate([best[0], step[0]]), np.concatenate([best[1], step[1]])
            by = np.lexsort((spent, states))
            first = np.ones(len(by), bool)
            first[1:] = states[by][1:] != states[by][:-1]
            by = by[first]
            better = by[by >= len(best[0])]
            best, frontier = (states[by], spent[by]), (states[better], spent[better])
        walk, node = np.divmod(best[0], len(ids))
        return pa.table({"start": ids[walk], "node": ids[node], "cost": best[1]})

    return rows.groupBy("cell", "part").applyInArrow(walks, "start long, node long, cost double")


def valid_routes(routes: DataFrame, turns: DataFrame) -> DataFrame:
    """FLT15: (route, valid): distinct edges, and each follows the one before legally. ``routes`` has (route, seq, edge)."""
    along = Window.partitionBy("route").orderBy("seq")
    steps = routes.withColumn("next", F.lead("edge").over(along))
    illegal = steps.filter("next IS NOT NULL").join(turns, ["edge", "next"], "left_anti").select("route").distinct().withColumn("illegal", F.lit(True))
    shape = routes.groupBy("route").agg((F.count("*") == F.count_distinct("edge")).alias("distinct"))
    return shape.join(illegal, "route", "left").select("route", (F.col("distinct") & F.col("illegal").isNull()).alias("valid"))


def route_offsets(routes: DataFrame, length: str) -> DataFrame:
    """WIN03: ``routes`` with where each edge begins and ends along its route."""
    along = Window.partitionBy("route").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return routes.withColumn("end_at", F.sum(length).over(along)).withColumn("begin_at", F.col("end_at") - F.col(length))


def edge_at(offsets: DataFrame, probes: DataFrame) -> DataFrame:
    """JOI18: (route, offset) probes with the first edge that ends at or after the offset; none outside the route."""
    met = probes.join(offsets.select("route", "seq", "edge", "begin_at", "end_at"), "route").filter((F.col("offset") >= F.col("begin_at")) & (F.col("offset") <= F.col("end_at")))
    first = met.groupBy("route", "offset").agg(F.min_by(F.struct("edge", "begin_at"), "seq").alias("m"))
    return first.select("route", "offset", F.col("m.edge").alias("edge"), (F.col("offset") - F.col("m.begin_at")).alias("along"))
