"""Ordered operators per key: gaps, islands, running sums, as-of joins, throttles, windows.

A drive (key) may hold a third of all rows, so nothing here needs a whole key in one task where the operator can be
split. Order-based operators take a ``bucket`` (a coarse, monotone function of time): rows are ordered within
(key, bucket), and one row per bucket carries the state across. ``throttle`` carries a small table a bucket, since its
state is one time. ``thin`` works per key: its state is a place, which no such table bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

DAY = 86_400_000_000


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def by_day(time: str) -> Column:
    return F.floor(F.col(time) / F.lit(DAY))


def with_previous(df: DataFrame, keys: list[str], order: list[str], carried: list[str], bucket: Column, name: str = "previous") -> DataFrame:
    """``df`` with a struct of ``carried`` of the row before, in ``order`` within ``keys`` (null for the first)."""
    dealt = df.withColumn("__bucket", bucket)
    inner = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    lasts = dealt.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(*carried), F.struct(*order)).alias("__last"))
    lasts = lasts.withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__bucket"))).drop("__last")
    out = dealt.withColumn("__lag", F.lag(F.struct(*carried)).over(inner)).join(lasts, [*keys, "__bucket"])
    return out.withColumn(name, F.coalesce("__lag", "__carry")).drop("__lag", "__carry", "__bucket")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in ``order`` within ``keys``."""
    dealt = df.withColumn("__bucket", bucket).withColumn("__value", value)
    inner = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy(*keys, "__bucket").agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    out = dealt.withColumn("__inner", F.sum("__value").over(inner)).join(totals, [*keys, "__bucket"])
    return out.withColumn(name, F.col("__inner") + F.col("__base")).drop("__inner", "__base", "__value", "__bucket")


def gaps(df: DataFrame, keys: list[str], time: str, tie: str, threshold: int, bucket: Column) -> DataFrame:
    """WIN02: rows that come more than ``threshold`` after the row before, with that row's time and the gap."""
    before = with_previous(df, keys, [time, tie], [time], bucket)
    gap = F.col(time) - F.col(f"previous.{time}")
    return before.withColumn("previous_time", F.col(f"previous.{time}")).withColumn("gap", gap).filter(F.col("gap") > threshold).drop("previous")


def islands(df: DataFrame, keys: list[str], time: str, tie: str, quiet: int, bucket: Column, name: str = "island") -> DataFrame:
    """WIN09: ``df`` with the number, from 1, of its run of rows that are at most ``quiet`` apart."""
    before = with_previous(df, keys, [time, tie], [time], bucket)
    opens = F.when(F.col("previous").isNull() | (F.col(time) - F.col(f"previous.{time}") > quiet), 1).otherwise(0)
    return running_sum(before, keys, [time, tie], opens, bucket, name).drop("previous")


def trapezoid(df: DataFrame, keys: list[str], time: str, tie: str, value: str, longest: int, bucket: Column, name: str = "distance") -> DataFrame:
    """WIN04: running trapezoid integral of ``value`` over seconds; steps longer than ``longest`` count nothing."""
    before = with_previous(df, keys, [time, tie], [time, value], bucket)
    step = F.col(time) - F.col(f"previous.{time}")
    area = (F.col(value) + F.col(f"previous.{value}")) / 2 * step / 1e6
    return running_sum(before, keys, [time, tie], F.when(step <= longest, area).otherwise(F.lit(0.0)), bucket, name).drop("previous")


def hold_last(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: list[str], bucket: Column, *, tie: str, name: str = "held") -> DataFrame:
    """JOI11/12: each ``left`` row with a struct of ``value`` of the last ``right`` row at or before its time."""
    l_cols = left.columns
    both = left.withColumn("__side", F.lit(1)).withColumn("__held", F.lit(None).cast(right.select(F.struct(*value).alias("s")).schema["s"].dataType))
    r = right.select(*keys, F.col(time), F.col(tie), F.lit(0).alias("__side"), F.struct(*value).alias("__held"))
    both = both.unionByName(r, allowMissingColumns=True).withColumn("__bucket", bucket)
    inner = Window.partitionBy(*keys, "__bucket").orderBy(time, "__side", tie).rowsBetween(Window.unboundedPreceding, 0)
    lasts = both.groupBy(*keys, "__bucket").agg(F.max_by("__held", F.when(F.col("__held").isNotNull(), F.struct(time, tie))).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("__carry", F.last("__last", ignorenulls=True).over(across)).drop("__last")
    out = both.withColumn("__inner", F.last("__held", ignorenulls=True).over(inner)).join(lasts, [*keys, "__bucket"]).filter("__side = 1")
    return out.select(*l_cols, F.coalesce("__inner", "__carry").alias(name))


def interpolated(instants: DataFrame, samples: DataFrame, keys: list[str], time: str, value: str, bucket: Column, *, tie: str) -> DataFrame:
    """JOI13: ``instants`` with ``value`` of ``samples`` at their time, linear between neighbours, null outside them.

    Both neighbours come from ``hold_last``, once forward and once in mirrored time.
    """
    before = hold_last(instants, samples, keys, time, [time, value], bucket, tie=tie, name="before")
    mirror = lambda df: df.withColumn(time, -F.col(time)).withColumn(tie, -F.col(tie))
    after = mirror(hold_last(mirror(before), mirror(samples), keys, time, [time, value], bucket, tie=tie, name="after"))
    t0, t1, v0, v1 = F.col(f"before.{time}"), -F.col(f"after.{time}"), F.col(f"before.{value}"), F.col(f"after.{value}")
    lerp = F.when(t1 > t0, v0 + (v1 - v0) * (F.col(time) - t0) / (t1 - t0)).otherwise(v0)
    return after.withColumn(value, F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), lerp)).drop("before", "after")


def integrated(instants: DataFrame, intervals: DataFrame, keys: list[str], time: str, value: str, bucket: Column, *, tie: str) -> DataFrame:
    """JOI16: ``instants`` with the integral of ``value`` up to their time, the last interval in part.

    ``intervals`` has (keys, ``time``, end, ``value``, ``tie``) in seconds or microseconds alike, without overlaps; ``bucket`` is
    of ``time``. Whole intervals are a running sum, and the interval that holds an instant counts up to it. Instants before
    the first interval get null.
    """
    part = intervals.withColumn("__area", F.col(value) * (F.col("end") - F.col(time)))
    run = running_sum(part, keys, [time, tie], F.col("__area"), bucket, "__til")
    run = run.select(*keys, time, tie, F.col("end").alias("__end"), F.col(value).alias("__rate"), (F.col("__til") - F.col("__area")).alias("__base"), F.col(time).alias("__start"))
    held = hold_last(instants, run, keys, time, ["__start", "__end", "__rate", "__base"], bucket, tie=tie, name="__h")
    reach = F.least(F.col(time), F.col("__h.__end")) - F.col("__h.__start")
    return held.withColumn("integral", F.col("__h.__base") + F.col("__h.__rate") * reach).drop("__h")


def last_n(df: DataFrame, kind: str, order: list[Column], n: int) -> DataFrame:
    """WIN22: the last ``n`` rows of each kind; spread first, so a hot kind is cut down in many tasks."""
    parts = Window.partitionBy(kind, "__part").orderBy(*order)
    cut = df.withColumn("__part", F.spark_partition_id()).withColumn("__n", F.row_number().over(parts)).filter(F.col("__n") <= n)
    return cut.withColumn("__n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("__n") <= n).drop("__part", "__n")


def hopping(df: DataFrame, time: str, size: int, hop: int) -> DataFrame:
    """WIN06: a row for each window of ``size`` that starts at a multiple of ``hop`` and holds the row."""
    first = F.floor((F.col(time) - size) / hop) + 1
    return df.withColumn("window_start", F.explode(F.transform(F.sequence(first, F.floor(F.col(time) / hop)), lambda k: k * F.lit(hop))))


def rolling(df: DataFrame, keys: list[str], time: str, span: int, measures: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """WIN05: ``df`` with ``measures`` over the rows of the last ``span`` up to each row's time.

    A row stands in the bucket of its own time and in the next, so a window is a bucket of twice ``span`` and not a key.
    """
    own = F.floor(F.col(time) / span)
    dealt = df.withColumn("__own", own).withColumn("__bucket", F.explode(F.array(own, own + 1)))
    back = Window.partitionBy(*keys, "__bucket").orderBy(time).rangeBetween(-span, 0)
    return dealt.withColumns({n: m(back) for n, m in measures.items()}).filter("__own = __bucket").drop("__own", "__bucket")


def throttle_marks(df: DataFrame, keys: list[str], time: str, tie: str, step: int, bucket: Column) -> DataFrame:
    """WIN15: ``df`` with its row number ``__n`` and ``__kept``: whether a row comes at least ``step`` after the last kept.

    Rows without a time go. Rows are numbered by ``bucket`` and dealt in blocks of ``BLOCK``. A block's outcome depends only on
    the last kept time before it: each block makes the table of its own last kept time by that time, which has few rows
    because chains from neighbouring starts soon meet; one pass over the blocks of a key follows the tables, and then every
    block marks its rows by itself.
    """
    numbered = running_sum(df.filter(F.col(time).isNotNull()), keys, [time, tie], F.lit(1), bucket, "__n")
    dealt = numbered.withColumn("__block", F.floor((F.col("__n") - 1) / BLOCK))
    when = dealt.schema[time].dataType
    groups = [*keys, "__block"]
    head = dealt.select(*groups)

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(rows[time].to_numpy())
        follow = np.searchsorted(t, t + step)
        last = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if follow[i] < len(t):
                last[i] = last[follow[i]]
        first = min(len(t), int(np.searchsorted(t, t[0] + step)) + 1)  # No earlier time reaches beyond these rows.
        ends = np.flatnonzero(np.append(last[1:first] != last[: first - 1], True))
        out = rows[groups].iloc[:1].copy()
        out["__til"], out["__last"] = [t[ends].tolist()], [last[ends].tolist()]
        return out

    times = T.ArrayType(when)
    tables = dealt.select(*groups, time).groupBy(*groups).applyInPandas(table, T.StructType([*head.schema.fields, T.StructField("__til", times), T.StructField("__last", times)]))

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__block")
        last, before = None, []
        for til, ends in zip(rows["__til"], rows["__last"], strict=True):
            before.append(last)
            at = 0 if last is None else int(np.searchsorted(til, last + step))
            last = ends[at] if at < len(ends) else last
        return rows[groups].assign(__before=pd.Series(before, index=rows.index, dtype=object))

    carried = tables.groupBy(*keys).applyInPandas(follow, T.StructType([*head.schema.fields, T.StructField("__before", when)]))
    schema = T.StructType([*dealt.schema.fields, T.StructField("__before", when), T.StructField("__kept", T.BooleanType())])

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([time, tie], kind="stable")
        before = rows["__before"].iloc[0]
        t, kept = rows[time].to_numpy(), np.zeros(len(rows), bool)
        at = 0 if pd.isna(before) else int(np.searchsorted(t, before + step))
        while at < len(t):
            kept[at] = True
            at = int(np.searchsorted(t, t[at] + step))
        return rows.assign(__kept=kept)[schema.names]

    return dealt.join(carried, groups).select(*schema.names[:-1]).groupBy(*groups).applyInPandas(mark, schema).drop("__before", "__block")


#: Rows of a key that a throttle runs in one piece.
BLOCK = 32_768


def throttle(df: DataFrame, keys: list[str], time: str, tie: str, step: int, bucket: Column) -> DataFrame:
    """WIN15: keeps a row only if it comes at least ``step`` after the last kept; ``suppressed`` counts those between."""
    kept = throttle_marks(df, keys, time, tie, step, bucket).filter("__kept").drop("__kept")
    before = with_previous(kept, keys, [time, tie], ["__n"], bucket)
    return before.withColumn("suppressed", F.coalesce(F.col("__n") - F.col("previous.__n") - 1, F.lit(0)).cast("long")).drop("previous", "__n")


def thin(df: DataFrame, keys: list[str], order: list[str], xy: tuple[str, str], least: float) -> DataFrame:
    """WIN21: keeps a point only if it lies more than ``least`` from the last kept."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        last, kept = None, []
        for i, p in enumerate(zip(rows[xy[0]].tolist(), rows[xy[1]].tolist(), strict=True)):
            if last is None or ((p[0] - last[0]) ** 2 + (p[1] - last[1]) ** 2) ** 0.5 > least:
                last = p
                kept.append(i)
        return rows.iloc[kept]

    return df.groupBy(*keys).applyInPandas(keep, df.schema)


def first_wins(parts: Iterable[DataFrame], keys: list[str]) -> DataFrame:
    """SET01: union of ``parts`` with, for each key, the row of the earliest part that has it."""
    ranked = [p.withColumn("__rank", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(DataFrame.unionByName, ranked)
    rest = [c for c in both.columns if c not in (*keys, "__rank")]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("__rank")).alias("__row"))
    return best.select(*keys, "__row.*")
