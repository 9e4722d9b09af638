"""Features of routes and signals: bends, compounds, straights, peaks, matches, backgrounds, spectra."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.functions.signal import erf
from roadtrace.operators.components import shared_folder
from roadtrace.operators.ordered import rolling, running_sum, throttle_marks, with_previous


def bends(turns: DataFrame, key: str, at: str, delta: str, active: float, quiet: float, least: float) -> DataFrame:
    """WIN10: runs of active heading changes that no more than ``quiet`` metres part: (key, bend, begin, end, angle, middle).

    ``middle`` is where the running angle first reaches half of its total. Routes are short, so a key is one window.
    """
    along = Window.partitionBy(key).orderBy(at)
    on = turns.filter(F.abs(delta) >= active)
    opened = on.withColumn("opens", F.coalesce((F.col(at) - F.lag(at).over(along) > quiet).cast("int"), F.lit(1))).withColumn("bend", F.sum("opens").over(along))
    inner = Window.partitionBy(key, "bend").orderBy(at)
    summed = opened.withColumn("run", F.sum(delta).over(inner)).withColumn("total", F.sum(delta).over(Window.partitionBy(key, "bend")))
    half = F.min(F.when(F.abs("run") >= F.abs("total") / 2, F.col(at)))
    out = summed.groupBy(key, "bend").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.sum(delta).alias("angle"), half.alias("middle"))
    return out.filter(F.abs("angle") >= least)


def compounds(features: DataFrame, key: str, most: float, low: float, high: float) -> DataFrame:
    """WIN11: consecutive features at most ``most`` apart whose angles add up to between ``low`` and ``high``."""
    along = Window.partitionBy(key).orderBy("begin")
    pair = features.withColumn("next", F.lead(F.struct("begin", "end", "angle")).over(along)).filter((F.col("next.begin") - F.col("end")).between(0, most))
    both = pair.select(key, "begin", F.col("next.end").alias("end"), (F.col("angle") + F.col("next.angle")).alias("angle"))
    return both.filter(F.abs("angle").between(low, high))


def straights(features: DataFrame, key: str, length: Column) -> DataFrame:
    """WIN13: the straight before and after each feature, to the neighbour or the route's end."""
    along = Window.partitionBy(key).orderBy("begin")
    return features.withColumns({"before": F.col("begin") - F.lag("end", 1, 0.0).over(along), "after": F.coalesce(F.lead("begin").over(along), length) - F.col("end")})


def peaks(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """WIN14: rows higher than the row before and not lower than the row after."""
    along = Window.partitionBy(key).orderBy(at)
    low = F.lit(float("-inf"))
    return df.withColumns({"__a": F.coalesce(F.lag(value).over(along), low), "__b": F.coalesce(F.lead(value).over(along), low)}).filter((F.col(value) > F.col("__a")) & (F.col(value) >= F.col("__b"))).drop("__a", "__b")


def matched(turns: DataFrame, features: DataFrame, key: str, angle: float, least: float) -> DataFrame:
    """JOI19: each turn's nearest feature of the same sense, within ``angle`` and max(``least``, half its length)."""
    t = turns.select(key, F.col("id").alias("turn"), F.col("middle").alias("at"), F.col("angle").alias("turned"))
    f = features.select(key, F.col("id").alias("feature"), "middle", "angle", ((F.col("end") - F.col("begin")) / 2).alias("half"))
    near = F.abs(F.col("at") - F.col("middle"))
    met = t.join(f, key).filter((F.signum("turned") == F.signum("angle")) & (F.abs(F.col("turned") - F.col("angle")) <= angle) & (near <= F.greatest(F.lit(least), F.col("half"))))
    best = met.groupBy(key, "turn").agg(F.min(F.struct(near.alias("d"), "feature")).alias("b"), F.count("*").alias("candidates"))
    return best.select(key, "turn", F.col("b.feature").alias("feature"), "candidates")


def top_groups(df: DataFrame, group: str, key: str, mass: str, first: int, last: int) -> DataFrame:
    """TOP01, TOP02: keys of rank ``first`` to ``last`` by mass, then key."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(mass), key))
    return df.withColumn("place", place).filter(F.col("place").between(first, last))


def background(df: DataFrame, key: str, order: list[str], value: str, length: int, bucket: Column, name: str = "background") -> DataFrame:
    """WIN18: b = (1 - 1/length) b + value/length from the first value on.

    The recurrence is linear: rows are numbered in ``order`` by buckets (see ``ordered``), each ``BLOCK`` of them runs
    from zero by itself, and one row a block carries the decayed value across. ``order`` must be unique within a key.
    """
    keep = 1 - 1 / length
    numbered = running_sum(df, [key], order, F.lit(1), bucket, "__n").withColumn("__block", F.floor((F.col("__n") - 1) / BLOCK))
    schema = numbered.withColumn("__own", F.lit(0.0)).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__n")
        own, last = [], 0.0
        for n, v in zip(rows["__n"].tolist(), rows[value].tolist(), strict=True):
            last = v if n == 1 else keep * last + v / length
            own.append(last)
        return rows.assign(__own=own)[schema.names]

    local = numbered.groupBy(key, "__block").applyInPandas(run, schema)
    ends = local.groupBy(key, "__block").agg(F.max_by("__own", "__n").alias("own"), F.count("*").alias("n"))

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__block")
        before, last = [], 0.0
        for own, n in zip(rows["own"].tolist(), rows["n"].tolist(), strict=True):
            before.append(last)
            last = keep**n * last + own
        return rows.assign(__carry=before)[[key, "__block", "__carry"]]

    carried = ends.groupBy(key).applyInPandas(carry, ends.select(key, "__block", F.lit(0.0).alias("__carry")).schema)
    decay = F.pow(F.lit(keep), F.col("__n") - F.col("__block") * BLOCK)
    return local.join(carried, [key, "__block"]).withColumn(name, F.col("__own") + decay * F.col("__carry")).drop("__n", "__block", "__own", "__carry")


#: Rows of a key that ``background`` runs in one piece.
BLOCK = 4096
#: Span of a numeric order that makes a bucket.
ROWS = 100_000


def downsampled(df: DataFrame, key: str, time: str, values: list[str], step: float, bucket: Column, *, tie: str | None = None) -> DataFrame:
    """WIN16: a row when at least ``step`` has passed since the last, with duration-weighted means of ``values``.

    The rows that end an interval are those that a throttle keeps; the rest is running sums by ``bucket`` and one grouping.
    """
    order = [time, tie] if tie else [time]
    marked = throttle_marks(df.select(key, *order, *(v for v in values if v not in order)), [key], time, tie or time, step, bucket).drop("__n")
    timed = with_previous(marked, [key], order, [time], bucket).withColumn("__width", F.col(time) - F.col(f"previous.{time}"))
    kept = F.col("__kept").cast("int")
    run = running_sum(timed, [key], order, kept, bucket, "__seen").withColumn("__interval", F.col("__seen") - kept).filter("__interval > 0")
    means = [(F.sum(F.col(v) * F.col("__width")) / F.sum("__width")).alias(v) for v in values]
    out = run.groupBy(key, "__interval").agg(F.max(F.when(F.col("__kept"), F.col(time))).alias(time), *means)
    return out.filter(F.col(time).isNotNull()).select(key, time, *values)


def spectrum(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """AGG25: Welch power density (Hann windows of ``size``, half overlapping), a row per key and frequency bin.

    The windows are dealt out first: each window of each key is a group of its own, and bins are averaged by Spark.
    """
    half = size // 2
    # Rows are numbered by buckets, since a key may hold a large part of all rows.
    rows = running_sum(df.select(key, order, F.col(value).cast("double").alias("x")), [key], [order], F.lit(1), F.floor(F.col(order) / ROWS), "n")
    numbered = rows.select(key, "x", (F.col("n") - 1).alias("n"))
    part = F.floor(F.col("n") / half)
    spread = numbered.withColumn("w", F.explode(F.array(part - 1, part))).filter("w >= 0")

    def power(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) < size:
            return pd.DataFrame({key: rows[key].iloc[:0], "bin": np.zeros(0, int), "power": np.zeros(0)})
        x = rows.sort_values("n")["x"].to_numpy()
        window = np.hanning(size)
        density = np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2 / (window**2).sum()
        density[1:-1] *= 2
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(density), "bin": np.arange(len(density)), "power": density})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, bin int, power double"
    return spread.groupBy(key, "w").applyInPandas(power, schema).groupBy(key, "bin").agg(F.avg("power").alias("power"), F.count("*").alias("windows"))


def short_term_noise(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """AGG25: deviation of first differences over the root of two."""
    before = with_previous(df.select(key, order, value), [key], [order], [value], F.floor(F.col(order) / ROWS))
    return before.select(key, (F.col(value) - F.col(f"previous.{value}")).alias("d")).groupBy(key).agg((F.stddev_pop("d") / 2**0.5).alias("noise"))


def banded_evidence(df: DataFrame, ratio: str, speed: str, score: str, bands: int, width: float) -> DataFrame:
    """AGG22: mean score of each ratio over the speed bands it is seen in, bands weighing alike."""
    banded = df.withColumn("band", F.least(F.floor(F.col(speed) / width), F.lit(bands - 1)))
    each = banded.groupBy(ratio, "band").agg(F.avg(score).alias("mean"), F.count("*").alias("n"))
    return each.groupBy(ratio).agg(F.avg("mean").alias("evidence"), F.count_if(F.col("n") >= 20).alias("full_bands"), F.sum("n").alias("windows"))


def settled(df: DataFrame, key: str, time: str, value: str, span: int, least: int, variance: float) -> DataFrame:
    """FLT17: rows whose last ``span`` holds at least ``least`` rows of at most ``variance``."""
    seen = rolling(df, [key], time, span, {"rows": lambda w: F.count("*").over(w), "variance": lambda w: F.var_pop(value).over(w)})
    return seen.filter((F.col("rows") >= least) & (F.col("variance") <= variance))


def calibration_record(df: DataFrame, key: str, time: str, channels: list[str]) -> DataFrame:
    """AGG21: rows, span, and mean and population deviation of each channel."""
    moments = [f(c).alias(f"{n}_{c}") for c in channels for n, f in (("mean", F.avg), ("deviation", F.stddev_pop))]
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.min(time).alias("begin"), F.max(time).alias("end"), *moments)


def calibration_intervals(df: DataFrame, key: str, order: list[str], still: Column, bucket: Column, *, span: float = 4.0, frames: int = 150, kept: int = 800) -> DataFrame:
    """FLT16: (key, begin, end, frames): each key's first interval of still frames that is long enough to calibrate by.

    A frame that isn't ``still`` ends an interval and the next begins behind it. An interval counts from the frame at which its last ``kept`` frames
    last ``span`` and number ``frames``; a key without such a frame has no row. The first column of ``order`` is the time; ``bucket`` is of it.
    """
    time = order[0]
    moves = running_sum(df.select(key, *order, still.alias("__still")), [key], order, F.when(F.coalesce("__still", F.lit(False)), 0).otherwise(1), bucket, "__island")
    numbered = running_sum(moves.filter("__still"), [key, "__island"], order, F.lit(1), bucket, "__n")
    oldest = numbered.select(key, "__island", (F.col("__n") + kept - 1).alias("__n"), F.col(time).alias("__old"))
    begun = numbered.groupBy(key, "__island").agg(F.min(time).alias("__begin"))
    held = numbered.join(begun, [key, "__island"]).join(oldest, [key, "__island", "__n"], "left").withColumn("begin", F.coalesce("__old", "__begin"))
    enough = held.filter((F.col(time) - F.col("begin") >= span) & (F.least("__n", F.lit(kept)) >= frames))
    first = enough.groupBy(key).agg(F.min(F.struct(*order, "begin", "__n")).alias("f"))
    return first.select(key, "f.begin", F.col(f"f.{time}").alias("end"), F.least("f.__n", F.lit(kept)).cast("long").alias("frames"))


def distinct_bends(features: DataFrame, key: str, least: float) -> DataFrame:
    """WIN12: of neighbours nearer than ``least`` with the same sense the larger angle stays; one pass a route."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("middle", kind="stable")
        kept: list[int] = []
        middle, angle = rows["middle"].tolist(), rows["angle"].tolist()
        for i in range(len(rows)):
            if kept and middle[i] - middle[kept[-1]] < least and (angle[i] > 0) == (angle[kept[-1]] > 0):
                if abs(angle[i]) > abs(angle[kept[-1]]):
                    kept[-1] = i
            else:
                kept.append(i)
        return rows.iloc[kept]

    return features.groupBy(key).applyInPandas(keep, features.schema)


def junctions(edges: DataFrame, turns: DataFrame, low: float, high: float) -> DataFrame:
    """JOI21: (edge, next, angle) of legal turns whose heading change lies between ``low`` and ``high`` radians.

    ``edges`` has (id, arrive, leave): the headings at its end and at its beginning.
    """
    a = edges.select(F.col("id").alias("edge"), "arrive")
    b = edges.select(F.col("id").alias("next"), "leave")
    change = F.col("leave") - F.col("arrive")
    met = turns.join(a, "edge").join(b, "next").withColumn("angle", F.atan2(F.sin(change), F.cos(change)))
    return met.filter(F.abs("angle").between(low, high)).select("edge", "next", "angle")


def unvisited(candidates: Column, route: Column, last: int = 15) -> Column:
    """SET05: candidates that are not among the last ``last`` of a route."""
    return F.array_except(candidates, F.slice(route, F.greatest(F.size(route) - last + 1, F.lit(1)), F.lit(last)))


def vibration_level(df: DataFrame, key: str, order: str, axes: list[str], *, size: int = 100, hop: int = 100, transform: int = 128, rate: float = 100.0, low: float = 3.0, high: float = 45.0) -> DataFrame:
    """AGG26: (key, window, level): the mean over ``axes`` of log10 of the median power between ``low`` and ``high`` hertz.

    Windows of ``size`` rows under a Hann window begin every ``hop`` rows and are groups of their own; short ones give none.
    """
    rows = running_sum(df.select(key, order, *axes), [key], [order], F.lit(1), F.floor(F.col(order) / ROWS), "__n").withColumn("__n", F.col("__n") - 1)
    first = F.greatest(F.floor((F.col("__n") - size) / hop) + 1, F.lit(0))
    spread = rows.filter(first <= F.floor(F.col("__n") / hop)).withColumn("window", F.explode(F.sequence(first, F.floor(F.col("__n") / hop))))

    def level(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[[key, "window"]].iloc[:1].assign(level=0.0)
        if len(rows) < size:
            return out.iloc[:0]
        x = rows.sort_values("__n")[axes].to_numpy(float)
        power = np.abs(np.fft.rfft((x - x.mean(axis=0)) * np.hanning(size)[:, None], n=transform, axis=0)) ** 2
        band = power[int(np.ceil(low * transform / rate)) : int(high * transform / rate) + 1]
        return out.assign(level=np.log10(np.median(band, axis=0) + 1e-14).mean())

    return spread.groupBy(key, "window").applyInPandas(level, f"{key} {df.schema[key].dataType.simpleString()}, window long, level double")


#: Channels whose spectra are correlated with themselves, with their weights (fixed values).
CHANNEL_WEIGHTS = {"accelerationX": 45.2, "rotationZ": 41.3, "vertical": 35.6, "rotationY": 31.8, "rotationX": 27.5, "accelerationZ": 24.4}


def channel_products(spectra: DataFrame, key: str, weights: dict[str, float], whitening: float = 0.8) -> DataFrame:
    """JOI25: (key, bin, product) of spectra (key, channel, bin, power): whitened products of each channel with itself.

    A channel's products are scaled by its whitened total, weighted, added by bin and divided by the weights of all channels.
    Channels without a weight count nothing.
    """
    weight = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    known = spectra.withColumn("__weight", weight[F.col("channel")]).filter("__weight IS NOT NULL")
    totals = known.groupBy(key, "channel").agg(F.sum(F.pow("power", F.lit(1 - whitening))).alias("__total"))
    scale = F.col("__weight") / F.sqrt(F.col("__total") * F.col("__total") + 1e-30)
    each = known.join(totals, [key, "channel"]).withColumn("__p", F.col("power") / (F.pow("power", F.lit(whitening)) + 1e-20) * scale)
    return each.groupBy(key, "bin").agg((F.sum("__p") / F.lit(sum(weights.values()))).alias("product"))


def credible_radius(mixture: DataFrame, centres: DataFrame, key: str, mass: float = 0.95) -> DataFrame:
    """AGG24: (key, radius): the least radius about a centre that holds ``mass`` of a mixture of normals.

    ``mixture`` has (key, weight, offset, variance), variances of at least 1 counting; ``centres`` (key, centre, length). The first radius
    of 1000, 2000, ... that holds enough, or reaches twice ``length``, is cut in ``PARTS`` eight times; each time the components
    add up their mass within every cut, so no mixture is one group.
    """
    shared_folder(mixture.sparkSession)
    deviation = F.sqrt(F.greatest("variance", F.lit(1.0))) * math.sqrt(2)

    def first(asked: DataFrame) -> DataFrame:
        """(key, i): the first radius of (key, centre, radii) that holds enough, else the last."""
        cut = asked.select(key, "centre", F.posexplode("radii").alias("i", "r"))
        away = lambda sign: erf((F.col("centre") + sign * F.col("r") - F.col("offset")) / deviation)
        held = mixture.join(cut, key).groupBy(key, "i").agg(F.sum(F.col("weight") * 0.5 * (away(1) - away(-1))).alias("held"))
        return held.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("held") >= mass, F.col("i"))), F.max("i")).alias("i"))

    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("length") * 2 / 1000))).cast("int")
    begun = centres.withColumn("radii", F.transform(F.sequence(F.lit(0), doublings), lambda j: F.lit(1000.0) * F.pow(F.lit(2.0), j)))
    state = begun.join(first(begun), key).select(key, "centre", F.lit(0.0).alias("low"), F.get("radii", "i").alias("high")).checkpoint()
    for _ in range(8):
        step = (F.col("high") - F.col("low")) / PARTS
        asked = state.withColumn("radii", F.transform(F.sequence(F.lit(1), F.lit(PARTS)), lambda j: F.col("low") + step * j))
        state = asked.join(first(asked), key).select(key, "centre", (F.col("low") + step * F.col("i")).alias("low"), F.get("radii", "i").alias("high")).checkpoint()
    return state.select(key, F.col("high").alias("radius"))


#: Cuts of an interval a round; eight rounds of 32 are forty halvings.
PARTS = 32


def basins(df: DataFrame, key: str, cell: str, value: str, *, dip: float = 0.3, step: float = 5.0, least: float = 1e-3) -> DataFrame:
    """WIN14: (key, first, last, mass, mean, variance): the separate peaks of a density sampled at whole ``cell`` numbers, heaviest first by mass.

    A peak is no lower than the cell before and higher than the one after. Two neighbouring peaks are apart if the lowest cell from the one to the
    other is below ``dip`` times the smaller; else the higher stands for both. A basin reaches from valley to valley; lighter ones than ``least`` of the
    heaviest go. Cells of a key follow each other without a gap. Peaks and the valleys between them are found by cells in blocks, so what one
    task sees of a key is its peaks alone.
    """
    shared_folder(df.sparkSession)
    low = F.lit(-1.0)
    rows = df.select(key, F.col(cell).cast("long").alias("__at"), F.col(value).cast("double").alias("__v"))
    beside = lambda d: rows.select(key, (F.col("__at") - d).alias("__at"), F.col("__v").alias(f"__{'r' if d > 0 else 'l'}"))
    around = rows.join(beside(1), [key, "__at"], "left").join(beside(-1), [key, "__at"], "left")
    top = (F.col("__v") > 0) & (F.col("__v") >= F.coalesce("__l", low)) & (F.col("__v") > F.coalesce("__r", low))
    peak = running_sum(around.withColumn("__peak", top), [key], ["__at"], F.col("__peak").cast("int"), F.floor(F.col("__at") / ROWS), "__n").checkpoint()
    # The lowest cell from a peak to the next; of equal ones the first.
    valleys = peak.filter("__n > 0").groupBy(key, "__n").agg(F.min(F.when(~F.col("__peak"), F.struct("__v", "__at"))).alias("__valley"), F.max(F.when(F.col("__peak"), F.struct("__v", "__at"))).alias("__top"))
    schema = T.StructType([df.schema[key], T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        opens, kept, deepest = [(None, 0)], None, None
        for at, top, valley_at, valley in zip(rows["top_at"], rows["top"], rows["valley_at"], rows["valley"], strict=True):
            if kept is None:
                kept = top
            elif deepest[0] < dip * min(kept, top):
                opens.append((deepest[1], len(opens)))
                kept = top
                deepest = None
            else:
                if top > kept:
                    kept, deepest = top, None
            here = (top, at) if pd.isna(valley) else min((valley, valley_at), (top, at))
            deepest = here if deepest is None else min(deepest, here)
        return pd.DataFrame({key: rows[key].iloc[0], "first": [o[0] for o in opens], "n": [o[1] for o in opens]})[schema.names]

    listed = valleys.select(key, F.col("__n").alias("n"), F.col("__top.__v").alias("top"), F.col("__top.__at").alias("top_at"), F.col("__valley.__v").alias("valley"), F.col("__valley.__at").alias("valley_at"))
    bounds = listed.groupBy(key).applyInPandas(cut, schema).checkpoint()
    # Every cell learns its basin from the last opening at or before it.
    opened = bounds.select(key, F.coalesce("first", F.lit(-(1 << 62))).alias("__at"), F.lit(0).alias("__row"), F.col("n").alias("__opens"), F.lit(None).cast("double").alias("__v"))
    cells = rows.join(bounds.select(key).distinct(), key, "left_semi").select(key, "__at", F.lit(1).alias("__row"), F.lit(None).cast("long").alias("__opens"), "__v")
    held = running_sum(opened.unionByName(cells), [key], ["__at", "__row"], 1 - F.col("__row"), F.floor(F.col("__at") / ROWS), "__basin").filter("__row = 1")
    place = F.col("__at") * F.lit(step)
    sums = held.groupBy(key, "__basin").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.sum("__v").alias("__mass"), F.sum(F.col("__v") * place).alias("__moment")).filter((F.col("__mass") > 0) & (F.col("__mass") < F.lit(float("inf"))))
    sums = sums.withColumn("mean", F.col("__moment") / F.col("__mass"))
    spread = held.join(sums.select(key, "__basin", "mean"), [key, "__basin"]).groupBy(key, "__basin").agg(F.sum(F.col("__v") * (place - F.col("mean")) ** 2).alias("__spread"))
    made = sums.join(spread, [key, "__basin"])
    heaviest = made.groupBy(key).agg(F.max("__mass").alias("__most"))
    fits = made.join(heaviest, key).filter(F.col("__mass") >= F.lit(least) * F.col("__most"))
    variance = F.greatest(F.lit(16.0), F.col("__spread") / F.col("__mass") + F.lit(step * step / 12))
    return fits.select(key, "first", "last", (F.col("__mass") * step).alias("mass"), "mean", variance.alias("variance"))
