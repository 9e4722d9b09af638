"""Aggregates: weighted, circular and robust statistics, pooling, error summaries.

All are sums, minima or exact percentiles by group, so Spark combines them before the shuffle; where a second pass
needs the first one's result (spread about a centre, outliers about a median) the result is joined back by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """AGG04."""
    return F.sum(value * weight) / F.sum(weight)


def effective_size(weight: Column) -> Column:
    """AGG05: effective sample size of weights that are normalised by their sum."""
    return F.sum(weight) * F.sum(weight) / F.greatest(F.lit(1e-12), F.sum(weight * weight))


def circular_mean(angle: Column, weight: Column) -> Column:
    """AGG06: weighted mean direction."""
    return F.atan2(F.sum(weight * F.sin(angle)), F.sum(weight * F.cos(angle)))


def heaviest(df: DataFrame, group: list[str], key: str, weight: str) -> DataFrame:
    """AGG07: per group the key with the largest summed weight, the smallest key on a tie."""
    mass = df.groupBy(*group, key).agg(F.round(F.sum(weight), 6).alias("mass"))
    best = mass.groupBy(*group).agg(F.min(F.struct((-F.col("mass")).alias("m"), F.col(key).alias("k"))).alias("b"))
    return best.select(*group, F.col("b.k").alias(key), (-F.col("b.m")).alias("mass"))


def spread(df: DataFrame, group: list[str], x: str, y: str, weight: str) -> DataFrame:
    """AGG08: weighted variance of points about their weighted centre."""
    w = F.col(weight)
    sums = df.groupBy(*group).agg(F.sum(w).alias("w"), *(F.sum(w * F.col(c)).alias(f"s{c}") for c in (x, y)), F.sum(w * (F.col(x) * F.col(x) + F.col(y) * F.col(y))).alias("q"))
    sx, sy = F.col(f"s{x}") / F.col("w"), F.col(f"s{y}") / F.col("w")
    return sums.select(*group, (F.col("q") / F.col("w") - sx * sx - sy * sy).alias("variance"))


def mad_filter(df: DataFrame, group: list[str], value: str, floor: float) -> DataFrame:
    """AGG12: the rows within max(floor, 3.5 * 1.4826 * MAD) of their group's median."""
    centre = df.groupBy(*group).agg(F.percentile(value, 0.5).alias("__median"))
    about = df.join(centre, group).withColumn("__off", F.abs(F.col(value) - F.col("__median")))
    width = about.groupBy(*group).agg(F.percentile("__off", 0.5).alias("__mad"))
    return about.join(width, group).filter(F.col("__off") <= F.greatest(F.lit(floor), 3.5 * 1.4826 * F.col("__mad"))).drop("__off", "__mad", "__median")


def inverse_variance(df: DataFrame, group: list[str], value: Column, sigma: Column) -> DataFrame:
    """AGG19: pooled estimate, its error and count; confident from two on with at most 1.5 % error."""
    sums = df.groupBy(*group).agg(F.sum(1 / (sigma * sigma)).alias("w"), F.sum(value / (sigma * sigma)).alias("s"), F.count("*").alias("n"))
    out = sums.withColumn("estimate", F.col("s") / F.col("w")).withColumn("error", 1 / F.sqrt("w"))
    return out.withColumn("confident", (F.col("n") >= 2) & (F.col("error") <= 0.015 * F.abs("estimate"))).drop("w", "s")


def error_summary(df: DataFrame, group: list[str], error: Column, within: Column, *, time: Column | None = None, stage: Column | None = None, failure: Column | None = None) -> DataFrame:
    """AGG13: 95th percentile, largest error and share within the stated uncertainty.

    With ``time``: the last error; with ``stage`` as well the accepted and detected turns; with ``failure`` the first failure.
    """
    parts = [F.percentile(error, 0.95).alias("p95"), F.max(error).alias("worst"), F.avg(within.cast("double")).alias("covered"), F.count("*").alias("n")]
    if time is not None:
        parts.append(F.max_by(error, F.when(error.isNotNull(), time)).alias("last"))
    if stage is not None:
        parts += [F.count_if(stage == name).alias(name) for name in ("accepted", "detected")]
    if failure is not None and time is not None:
        parts.append(F.min_by(failure, F.when(failure.isNotNull(), time)).alias("failure"))
    return df.groupBy(*group).agg(*parts)


def signal_statistics(df: DataFrame, group: list[str], channels: list[str]) -> DataFrame:
    """AGG14: RMS, population deviation and 95th percentile of the magnitude, a row per channel."""
    long = df.select(*group, F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("x")) for c in channels))).alias("c")).select(*group, "c.*")
    return long.groupBy(*group, "channel").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.stddev_pop("x").alias("deviation"), F.percentile(F.abs("x"), 0.95).alias("p95"))


def longest_member(df: DataFrame, group: list[str], length: str, member: str) -> DataFrame:
    """AGG15: the longest member of each group, the smallest id on a tie."""
    best = df.groupBy(*group).agg(F.min(F.struct((-F.col(length)).alias("l"), F.col(member).alias("m"))).alias("b"))
    return best.select(*group, F.col("b.m").alias(member), (-F.col("b.l")).alias(length))


def median_of_few(values: Column) -> Column:
    """AGG11: upper median of a short array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))
