"""Places: nearest settlement, suppression of duplicates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.operators.components import shared_folder
from roadtrace.operators.spatial import around, cell


def _closest(points: DataFrame, towns: DataFrame, size: float, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, place, score): the best of the 3x3 cells of ``size`` around each point, where they hold any.

    Each bonus is searched by itself, where the best is the nearest, from cells so narrow that none holds more than ``FEW``
    up to ``size``; narrower cells nest in wider ones, so a hit nearer than one width ends its search. Cells follow the
    density, and pairs grow with the points alone.
    """
    fine, width = 0, size
    while fine < FINEST and (most := cell(towns, width, "sx", "sy").groupBy("bonus", "cx", "cy").count().agg(F.max("count")).first()[0] or 0) > FEW:
        fine += max(1, math.ceil(math.log(most / FEW, 4)))
        width = size / 2**fine
    bonuses = towns.agg(F.sort_array(F.collect_set("bonus")).alias("b")).first()["b"]
    rest = points.withColumn("bonus", F.explode(F.array(*map(F.lit, bonuses)).cast("array<double>")))
    distance = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    found = None
    for level in range(fine, -1, -1):
        width = size / 2**level
        met = around(rest, width).join(side(cell(towns, width, "sx", "sy")), ["bonus", "cx", "cy"]).withColumn("d", distance)
        near = met.groupBy("id", "bonus").agg(F.min(F.struct((F.col("d") - F.col("bonus")).alias("score"), "place", "d")).alias("b"))
        if level:
            # Cells beyond are farther than one width by more than rounding can hide.
            near = near.filter(F.col("b.d") <= width * (1 - 1e-9)).checkpoint()
            rest = rest.join(near, ["id", "bonus"], "left_anti").checkpoint()
        found = near if found is None else found.unionByName(near)
    return found.groupBy("id").agg(F.min(F.struct("b.score", "b.place")).alias("b")).select("id", "b.place", "b.score")


def nearest_settlement(points: DataFrame, settlements: DataFrame, size: float, bonus: dict[str, float]) -> DataFrame:
    """JOI07: (id, place): the settlement with the least distance less its kind's bonus, among the 3x3 cells around.

    Points without a settlement there take the best of all. Their search doubles the cells' width until it is at least the
    best score plus the largest bonus: whatever lies outside the 3x3 cells is farther than one width, so it can't win.
    """
    shared_folder(points.sparkSession)
    weight = F.create_map(*(F.lit(x) for pair in bonus.items() for x in pair)) if bonus else F.create_map(F.lit(""), F.lit(0.0))
    s = settlements.select(F.col("id").alias("place"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.coalesce(weight[F.col("kind")], F.lit(0.0)).alias("bonus"))
    s = s.groupBy("sx", "sy", "bonus").agg(F.min("place").alias("place"))  # Of settlements at one place the smallest id wins every tie.
    some = s.limit(BROADCAST + 1).count()
    if not some:
        return points.select("id", F.lit(None).cast(s.schema["place"].dataType).alias("place"), F.lit(None).cast("double").alias("score")).limit(0)
    side = F.broadcast if some <= BROADCAST else lambda df: df
    found = _closest(points.select("id", "x", "y"), s, size, side).checkpoint()
    rest = points.select("id", "x", "y").join(found, "id", "left_anti").checkpoint()
    placed = rest.select("x", "y").union(s.select("sx", "sy")).filter((F.abs("x") < F.lit(float("inf"))) & (F.abs("y") < F.lit(float("inf"))))
    span = placed.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span")).first()["span"] or 0.0
    most, width, seen_all = max([0.0, *bonus.values()]), size, False
    while not seen_all and not rest.isEmpty():
        width *= 2
        seen_all = width > span
        met = _closest(rest, s, width, side)
        ended = (met if seen_all else met.filter(F.col("score") + most <= width)).checkpoint()
        found, rest = found.unionByName(ended), rest.join(ended, "id", "left_anti").checkpoint()
    return found


#: Settlements of one bonus that a cell of the narrowest search may hold, and how often a cell may be halved for that; both only set the speed.
FEW = 8
FINEST = 24
#: Settlements that may be broadcast to the joins by cell; the result is the same beyond.
BROADCAST = 10_000


def suppressed(df: DataFrame, keys: list[str], order: list[str], most: float) -> DataFrame:
    """JOI10: in ``order``, a row goes if a kept row of the same keys lies within ``most`` (columns x, y).

    The greedy pass is the first independent set in order, and that is found by rounds: a row stays once none of its earlier neighbours is
    undecided or kept, and goes once one is kept. Neighbours meet by grid cells, so no key comes together in one task. A cell of half
    of ``most`` across holds at most one kept row a key; so before any pair is made, the rows of such a cell that
    come after one known to stay are gone. Rows that tie in ``order`` are told apart by a number; rows without a finite place stay.
    Rounds grow with the longest chain of neighbours in order, which is short unless the order follows the plane.
    """
    shared_folder(df.sparkSession)
    # Within a cell of this width all rows are neighbours of each other.
    small = most / 1.5
    told = df.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    fine = [F.floor(F.col("x") / small).alias("__fx"), F.floor(F.col("y") / small).alias("__fy")]
    left = told.select("__id", F.struct(*(F.col(c) for c in order), "__id").alias("__at"), F.struct(*(F.col(k) for k in keys)).alias("__key"), "x", "y", *fine)
    finite = [F.col(c).isNotNull() & (F.abs(F.col(c)) < F.lit(float("inf"))) for c in "xy"]
    unplaced = left.filter(~(finite[0] & finite[1]))
    left = left.filter(finite[0] & finite[1])
    kept = unplaced.select("__id", "__key", "x", "y", "__fx", "__fy")
    span = F.sequence(F.lit(-2), F.lit(2))
    while True:
        # Of a cell only its first row can stay next, and it stays if it is the first of all its neighbours: those are first rows of cells around.
        first = left.groupBy("__key", "__fx", "__fy").agg(F.min(F.struct("__at", "__id", "x", "y")).alias("f")).select("__key", "__fx", "__fy", "f.*").checkpoint()
        if first.isEmpty():
            break
        rivals = left.select("__key", F.col("__at").alias("__rival"), F.col("x").alias("__rx"), F.col("y").alias("__ry"), "__fx", "__fy")
        spread = lambda rows: rows.withColumn("__dx", F.explode(span)).withColumn("__dy", F.explode(span)).withColumn("__fx", F.col("__fx") + F.col("__dx")).withColumn("__fy", F.col("__fy") + F.col("__dy")).drop("__dx", "__dy")
        near = (F.col("x") - F.col("__rx")) ** 2 + (F.col("y") - F.col("__ry")) ** 2 <= most * most
        beaten = spread(first).join(rivals, ["__key", "__fx", "__fy"]).filter(near & (F.col("__rival") < F.col("__at"))).select("__id").distinct()
        stays = first.join(beaten, "__id", "left_anti").select("__id", "__key", "x", "y", "__fx", "__fy").checkpoint()
        kept = kept.unionByName(stays)
        blocked = spread(stays.select("__key", F.col("x").alias("__rx"), F.col("y").alias("__ry"), "__fx", "__fy"))
        gone = left.join(blocked, ["__key", "__fx", "__fy"]).filter(near).select("__id").distinct()
        left = left.join(gone, "__id", "left_anti").checkpoint()
    return told.join(kept.select("__id"), "__id", "left_semi").drop("__id")
