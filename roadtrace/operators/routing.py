"""Routes over legal turns, for many requests at once.

The search relaxes the frontier of all requests together: each round is a join of the improved (request, edge) states
with the turns and a minimum per state, so requests spread over the cluster and no graph is sent to a task. A round
ends in a stored table. Cost is that of the edges left; the arrival edge counts nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadtrace.operators.components import forget, shared_folder, stored


def shortest(edges: DataFrame, turns: DataFrame, requests: DataFrame, *, most: float = float("inf")) -> DataFrame:
    """GRF05, GRF06: (request, cost, route) with the edges of the cheapest route, for (request, start, goal).

    ``edges`` has (id, cost); ``turns`` (edge, next). Without a route there is no row. Ties go to the smaller
    predecessor.
    """
    # A road that leads nowhere is on no route unless it is a goal.
    useful = turns.select(F.col("edge").alias("next")).union(requests.select("goal")).distinct()
    leave = stored(turns.join(useful, "next", "left_semi").join(edges.select(F.col("id").alias("edge"), F.col("cost").alias("step")), "edge"))
    # A few states may have very many turns, so small tables aren't gathered into a few tasks.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = frontier = stored(requests.select("request", "goal", F.col("start").alias("edge"), F.lit(0.0).alias("cost"), F.lit(0).alias("round")))
    made = 0
    while True:
        made += 1
        moved = frontier.repartition(tasks, "edge").join(leave, "edge").select("request", "goal", F.col("next").alias("edge"), (F.col("cost") + F.col("step")).alias("cost")).filter(F.col("cost") <= most)
        best = moved.groupBy("request", "goal", "edge").agg(F.min("cost").alias("cost"))
        # Nothing beyond the cost at which a request's goal is reached can help it.
        bound = state.filter("edge = goal").select("request", F.col("cost").alias("reached"))
        old = state.select("request", "edge", F.col("cost").alias("old"))
        better = best.join(old, ["request", "edge"], "left").join(bound, "request", "left")
        new = stored(better.filter("(old IS NULL OR cost < old) AND (reached IS NULL OR cost < reached)").select("request", "goal", "edge", "cost", F.lit(made).alias("round")))
        if new.isEmpty():
            break
        # What is new is cheaper, so the least cost and the last round belong together.
        known = stored(state.unionByName(new).groupBy("request", "goal", "edge").agg(F.min("cost").alias("cost"), F.max("round").alias("round")))
        for table in {id(t): t for t in (state, frontier)}.values():
            forget(table)
        state, frontier = known, new
    at = state.filter("edge = goal").select("request", F.col("cost").alias("total"), F.col("edge").alias("at"), F.col("cost").alias("at_cost"), F.col("round").alias("at_round"), F.array("edge").alias("route"))
    done = None
    while True:
        ready = at.filter("at_round = 0").select("request", F.col("total").alias("cost"), "route")
        done = ready if done is None else done.unionByName(ready)
        # A state's predecessors are those of the round before whose cost and step give its cost.
        step = at.join(leave.withColumnRenamed("next", "at"), "at").join(state.select("request", "edge", "cost", "round"), ["request", "edge"]).filter("round = at_round - 1 AND cost + step = at_cost")
        first = step.groupBy("request", "total", "route").agg(F.min(F.struct("edge", "cost", "round")).alias("b"))
        at = stored(first.select("request", "total", F.col("b.edge").alias("at"), F.col("b.cost").alias("at_cost"), F.col("b.round").alias("at_round"), F.concat(F.array("b.edge"), "route").alias("route")))
        if at.isEmpty():
            return stored(done)


def alternatives(edges: DataFrame, turns: DataFrame, requests: DataFrame, *, rounds: int = 6, penalty: float = 1.8, most: int = 3, longer: float = 1.5, shared: float = 0.75, longest: float = float("inf")) -> DataFrame:
    """GRF07: (request, option, cost, route): the best route and others found by making offered edges dearer.

    Each round multiplies the cost of all edges offered so far to the request; a route counts if it costs at most
    ``longer`` times the best and shares less than ``shared`` of its cost with every route before it.
    ``edges`` has one cost for all requests, so penalties live in a per-request table.
    """
    shared_folder(edges.sparkSession)
    best = shortest(edges, turns, requests, most=longest).withColumn("option", F.lit(1)).checkpoint()
    chosen = best.select("request", "option", "cost", "route").checkpoint()
    offered = chosen
    for made in range(rounds):
        uses = offered.select("request", F.explode("route").alias("id")).groupBy("request", "id").agg(F.count("*").alias("times"))
        dear = uses.join(edges, "id").select("request", "id", (F.col("cost") * F.pow(F.lit(penalty), F.col("times"))).alias("cost"))
        # A route above ``longer`` times the best can't be offered, so its penalised cost needs no search beyond the largest penalty.
        found = _penalised(edges, turns, best.select("request", (F.col("cost") * longer * penalty ** (made + 1)).alias("within")).join(requests, "request"), dear)
        real = found.select("request", F.explode("route").alias("id"), "route").join(edges, "id").groupBy("request", "route").agg(F.sum("cost").alias("full"))
        real = real.join(edges.select(F.col("id").alias("goal_id"), F.col("cost").alias("last")), F.element_at("route", -1) == F.col("goal_id")).select("request", "route", (F.col("full") - F.col("last")).alias("cost"))
        limit = best.select("request", (F.col("cost") * longer).alias("limit"))
        overlap = real.select("request", "route", "cost", F.explode("route").alias("id")).join(chosen.select("request", "option", F.explode("route").alias("id")), ["request", "id"]).join(edges.select("id", F.col("cost").alias("c")), "id").groupBy("request", "route", "option").agg((F.sum("c") / F.max("cost")).alias("part")).groupBy("request", "route").agg(F.max("part").alias("part"))
        new = real.join(limit, "request").filter("cost <= limit").join(overlap, ["request", "route"], "left").filter(F.coalesce("part", F.lit(0.0)) < shared)
        counts = chosen.groupBy("request").agg(F.max("option").alias("n")).filter(F.col("n") < most)
        chosen = chosen.unionByName(new.join(counts, "request").select("request", (F.col("n") + 1).alias("option"), "cost", "route")).checkpoint()
        offered = offered.unionByName(found.select("request", F.lit(0).alias("option"), "cost", "route")).checkpoint()
    return chosen


def _penalised(edges: DataFrame, turns: DataFrame, requests: DataFrame, dear: DataFrame) -> DataFrame:
    """``shortest`` where ``dear`` (request, id, cost) replaces an edge's cost for a request."""
    state = requests.select("request", "goal", F.col("start").alias("edge"), F.lit(0.0).alias("cost"), F.array("start").alias("route")).checkpoint()
    within = requests.select("request", "within")
    own = dear.select("request", F.col("id").alias("edge"), F.col("cost").alias("own"))
    plain = edges.select(F.col("id").alias("edge"), F.col("cost").alias("step"))
    frontier = state
    while True:
        left = frontier.join(plain, "edge").join(own, ["request", "edge"], "left").withColumn("cost", F.col("cost") + F.coalesce("own", "step")).join(within, "request").filter("cost <= within")
        moved = left.join(turns, "edge").select("request", "goal", F.col("next").alias("edge"), "cost", F.concat("route", F.array("next")).alias("route"))
        best = moved.groupBy("request", "goal", "edge").agg(F.min(F.struct("cost", "route")).alias("b")).select("request", "goal", "edge", "b.cost", "b.route")
        bound = state.filter("edge = goal").select("request", F.col("cost").alias("reached"))
        better = best.join(state.select("request", "edge", F.col("cost").alias("old")), ["request", "edge"], "left").join(bound, "request", "left")
        frontier = better.filter("(old IS NULL OR cost < old) AND (reached IS NULL OR cost < reached)").select("request", "goal", "edge", "cost", "route").checkpoint()
        if frontier.isEmpty():
            return state.filter("edge = goal").select("request", "cost", "route")
        state = state.unionByName(frontier).groupBy("request", "goal", "edge").agg(F.min(F.struct("cost", "route")).alias("b")).select("request", "goal", "edge", "b.cost", "b.route").checkpoint()


def clipped(routes: DataFrame, edges: DataFrame, start_at: str, goal_at: str) -> DataFrame:
    """GRF11: (request, metres) of routes (request, route, start_at, goal_at) with the first and last edge cut."""
    along = routes.select("request", start_at, goal_at, F.size("route").alias("n"), F.posexplode("route").alias("seq", "id")).join(edges.select("id", "length"), "id")
    whole = F.sum(F.when(F.col("seq") < F.col("n") - 1, F.col("length")).otherwise(0.0))
    return along.groupBy("request").agg((whole - F.max(start_at) + F.max(goal_at)).alias("metres"))


def through(edges: DataFrame, turns: DataFrame, stops: DataFrame) -> DataFrame:
    """(request, cost, route) through ordered stops (request, seq, edge); the legs are searched together.

    A request with an unreachable leg has no row.
    """
    along = Window.partitionBy("request").orderBy("seq")
    legs = stops.withColumn("goal", F.lead("edge").over(along)).filter("goal IS NOT NULL")
    asked = legs.select(F.struct("request", "seq").alias("request"), F.col("edge").alias("start"), "goal")
    found = shortest(edges, turns, asked).select("request.request", "request.seq", "cost", "route")
    joined = found.groupBy("request").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("seq", "route"))).alias("parts"))
    # Each leg begins with the edge that the one before ends with.
    route = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["route"]).otherwise(F.slice(p["route"], F.lit(2), F.size(p["route"])))))
    whole = legs.groupBy("request").agg(F.count("*").alias("wanted"))
    return joined.join(whole, "request").filter("n = wanted").select("request", "cost", route.alias("route"))
