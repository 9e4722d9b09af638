"""Heading against distance: what a drive's gyro saw before a turn, on a grid of distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.operators.components import shared_folder
from roadtrace.operators.ordered import hold_last, integrated, interpolated

#: Longest profile, what it shows before the turn, the step by which it gives way to the yaw history, its least length, and its grid.
LONGEST, BEFORE, GIVES_WAY, LEAST, GRID, FEWEST, MOST = 2000.0, 40.0, 20.0, 20.0, 5.0, 8, 80


def observed_profiles(turns: DataFrame, travel: DataFrame, yaw: DataFrame, key: str, *, time_bucket: float, distance_bucket: float) -> DataFrame:
    """WIN26: (key, turn, place, distance, heading, since_start): the integrated yaw at equal distances back from now, to before the turn began.

    ``turns`` has (key, turn, start, now, speed), ``travel`` (key, time, distance) with growing distances, ``yaw`` (key, time, end, rate) without overlaps. The
    profile reaches to BEFORE metres ahead of the turn's start, at most LONGEST and not beyond the travel history; while the yaw history begins later than its first point
    it gives way by GIVES_WAY. Its points are about GRID apart; their times come from the travel history read backwards (the first time at a distance), their
    headings from the running yaw integral. Turns without a travel history by then, or with less than LEAST to show, have none.

    All reading is as-of joins by (key, bucket of time or of distance), so a drive of any length is split.
    """
    shared_folder(turns.sparkSession)
    by_time, by_distance = F.floor(F.col("time") / time_bucket), F.floor(F.col("distance") / distance_bucket)
    path = travel.select(key, "time", "distance").withColumn("tie", F.lit(0))
    asked = turns.select(key, "turn", "start", "now", F.greatest("speed", F.lit(0.0)).alias("speed"))
    begun = path.groupBy(key).agg(F.min("time").alias("first_time"), F.min_by("distance", "time").alias("first_distance"))
    opens = yaw.groupBy(key).agg(F.min("time").alias("earliest"))
    last = hold_last(asked.withColumn("time", F.col("now")).withColumn("tie", F.lit(0)), path, [key], "time", ["time", "distance"], by_time, tie="tie", name="last").filter("last IS NOT NULL").drop("time", "tie")
    # An as-of join reads its left side twice, so each begins from a checkpoint.
    known = last.join(begun, key).join(opens, key).checkpoint()

    def distance_at(rows: DataFrame, when: str, name: str) -> DataFrame:
        """The distance at a time between the first and the last row of the history, and that of the nearer end beyond."""
        within = F.greatest(F.least(F.col(when), F.col("last.time")), F.col("first_time"))
        at = interpolated(rows.withColumn("time", within).withColumn("tie", F.lit(0)), path, [key], "time", "distance", by_time, tie="tie")
        return at.withColumnRenamed("distance", name).drop("time", "tie")

    known = distance_at(distance_at(known, "start", "start_distance").checkpoint(), "earliest", "yaw_distance").checkpoint()
    since_last = F.greatest(F.col("now") - F.col("last.time"), F.lit(0.0))
    driven = F.greatest(F.col("last.distance") - F.col("start_distance"), F.lit(0.0)) + F.col("speed") * F.greatest(F.col("now") - F.greatest(F.col("start"), F.col("last.time")), F.lit(0.0))
    known = known.withColumn("since_start", F.when(F.col("first_time") <= F.col("start"), driven).otherwise(F.col("speed") * F.greatest(F.col("now") - F.col("start"), F.lit(0.0))))
    known = known.withColumn("here", F.col("last.distance") + F.col("speed") * since_last)
    known = known.withColumn("span", F.least(F.lit(LONGEST), F.col("since_start") + BEFORE, F.col("here") - F.col("first_distance")))
    steps = lambda reach: F.greatest(F.ceil(reach / GIVES_WAY), F.lit(0))
    # Where the yaw history begins during a stop, that place was reached before it: the profile must begin beyond.
    edge = known.withColumn("last_time", F.col("last.time")).withColumn("last_distance", F.col("last.distance")).withColumn("distance", F.col("yaw_distance"))
    known = _times(edge, path, key, by_distance).withColumn("stopped", F.col("time") < F.col("earliest")).drop("time", "distance", "last_time", "last_distance").checkpoint()
    # Yaw that begins after the last travelled row covers no distance.
    lacks = F.when(F.col("earliest") > F.least("now", "last.time"), F.lit(float("inf"))).otherwise(F.col("yaw_distance") - F.col("here") + F.col("span"))
    given = F.when(F.col("earliest") > F.col("first_time"), F.least(F.when(F.col("stopped") & (lacks >= 0), F.floor(F.least(lacks, F.lit(1e9)) / GIVES_WAY) + 1).otherwise(steps(F.least(lacks, F.lit(1e9)))), steps(F.col("span") - LEAST))).otherwise(F.lit(0))
    known = known.withColumn("span", F.col("span") - given * GIVES_WAY).filter(F.col("span") >= LEAST).checkpoint()
    count = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.round(F.col("span") / GRID).cast("int")))
    points = known.withColumn("count", count).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("count")))).withColumn("back", F.col("span") * (1 - F.col("place") / F.col("count")))
    points = points.select(key, "turn", "place", "back", "since_start", "now", F.col("last.time").alias("last_time"), F.col("last.distance").alias("last_distance"), "first_time", "earliest", (F.col("here") - F.col("back")).alias("distance"))
    timed = _times(points, path, key, by_distance).checkpoint()
    whole = timed.groupBy(key, "turn").agg(F.min("time").alias("from_time"))
    timed = timed.join(whole, [key, "turn"]).filter(F.col("from_time") >= F.col("earliest")).drop("from_time")
    out = integrated(timed.withColumn("tie", F.lit(0)), yaw.select(key, "time", "end", "rate").withColumn("tie", F.lit(0)), [key], "time", "rate", by_time, tie="tie")
    return out.select(key, "turn", "place", F.col("back").alias("distance"), F.col("integral").alias("heading"), "since_start")


def _times(points: DataFrame, path: DataFrame, key: str, by_distance: Column) -> DataFrame:
    """``points`` with the time at which the history first reached their distance."""
    # A stop is one row: the way into it ends at its first time, the way out begins at its last.
    places = path.groupBy(key, "distance").agg(F.min("time").alias("reached"), F.max("time").alias("left")).withColumn("tie", F.lit(0))
    held = ["distance", "reached", "left"]
    before = hold_last(points.withColumn("tie", F.lit(0)), places, [key], "distance", held, by_distance, tie="tie", name="before")
    mirror = lambda df: df.withColumn("distance", -F.col("distance"))
    after = mirror(hold_last(mirror(before), mirror(places), [key], "distance", held, by_distance, tie="tie", name="after")).drop("tie")
    part = (F.col("distance") - F.col("before.distance")) / (-F.col("after.distance") - F.col("before.distance"))
    between = F.col("before.left") + (F.col("after.reached") - F.col("before.left")) * part
    time = F.when(F.col("distance") >= F.col("last_distance"), F.least("now", "last_time")).when(F.col("before.distance") == F.col("distance"), F.col("before.reached")).when(F.col("before").isNull(), F.col("first_time")).otherwise(between)
    return after.withColumn("time", time).drop("before", "after")
