"""Signal work on arrays as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hann(values: Column) -> Column:
    """FN10: values under a Hann window that is zero at both ends."""
    n = F.size(values)
    return F.transform(values, lambda v, i: v * F.when(n > 1, 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1))).otherwise(F.lit(1.0)))


def gaussian_blur(values: Column, sigma: float) -> Column:
    """FN10: values blurred by a Gaussian of radius floor(4 sigma + 0.5), the edge values going on outside."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(weights)
    n = F.size(values)
    at = lambda i, k: F.get(values, F.greatest(F.lit(0), F.least(i + k, n - 1)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((at(i, k) * (w / total) for k, w in zip(range(-radius, radius + 1), weights, strict=True)), F.lit(0.0)))


#: Samples a second of the motion channels, and the least speed at which a window is resampled by distance (fixed values).
RATE = 100.0
LEAST_SPEED = 3.0


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def distance_samples(velocity: pd.Series, current: pd.Series) -> pd.Series:
    """WIN24: fractional positions that resample a window to equal distances, from its integrated acceleration ``velocity``.

    The step is what the speed at the window's centre covers in one sample; ``current`` is the speed at its end. Null where
    that speed is below ``LEAST_SPEED``, the slowest is below half of it, or speeds spread by less than 2 % of it.
    """

    def positions(v: np.ndarray | None, now: float) -> np.ndarray | None:
        if v is None or not len(v) or now != now:
            return None
        v, middle = np.asarray(v, float), len(v) // 2
        centre = now - (v[-1] - v[middle])
        speeds = centre + v - v[middle]
        if not (centre >= LEAST_SPEED and speeds.min() >= 0.5 * centre and np.ptp(speeds) >= 0.02 * centre):
            return None
        driven = np.append(0.0, np.cumsum((speeds[1:] + speeds[:-1]) / 2 / RATE))
        wanted = driven[middle] + (np.arange(len(v)) - middle) * centre / RATE
        return np.interp(wanted, driven, np.arange(len(v), dtype=float))

    return pd.Series([positions(v, now) for v, now in zip(velocity, current, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    """The error function, which Spark lacks."""
    return x.map(math.erf)
