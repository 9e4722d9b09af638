"""Planar geometry as column expressions.

Coordinates are doubles; headings are clockwise from north, so their arctangent takes east before north. Polylines are
arrays of structs with fields x and y.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per degree of latitude, and the sphere's radius that follows (fixed values of the map format).
METRES_PER_DEGREE = 111_320.0
RADIUS = METRES_PER_DEGREE * 180 / math.pi
#: Metres per degree of latitude that the place index uses.
INDEX_METRES_PER_DEGREE = 110_574.0


def project_equirect(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """FN01."""
    return (lon - lon0) * (METRES_PER_DEGREE * math.cos(math.radians(lat0))), (lat - lat0) * METRES_PER_DEGREE


def unproject_equirect(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    return x / (METRES_PER_DEGREE * math.cos(math.radians(lat0))) + lon0, y / METRES_PER_DEGREE + lat0


def project_stereo(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """FN02: stereographic plane about an origin."""
    dl, phi = F.radians(lon - lon0), F.radians(lat)
    s, c = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    k = F.lit(2 * RADIUS) / (1 + s * F.sin(phi) + c * F.cos(phi) * F.cos(dl))
    return k * F.cos(phi) * F.sin(dl), k * (c * F.sin(phi) - s * F.cos(phi) * F.cos(dl))


def unproject_stereo(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """The inverse; the origin within a nanometre of it."""
    rho = F.sqrt(x * x + y * y)
    angle = 2 * F.atan(rho / (2 * RADIUS))
    s, c = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    lat = F.degrees(F.asin(F.cos(angle) * s + y * F.sin(angle) * c / rho))
    lon = lon0 + F.degrees(F.atan2(x * F.sin(angle), rho * c * F.cos(angle) - y * s * F.sin(angle)))
    return F.when(rho <= 1e-9, F.lit(lon0)).otherwise(lon), F.when(rho <= 1e-9, F.lit(lat0)).otherwise(lat)


def angle_difference(a: Column, b: Column) -> Column:
    """FN04: a - b, wrapped to a half turn either way."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def bearing(dx: Column, dy: Column) -> Column:
    """Heading of a vector, clockwise from north."""
    return F.atan2(dx, dy)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def segments(points: Column) -> Column:
    """Array of (a, b) of consecutive points."""
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segment_length(s: Column) -> Column:
    return F.sqrt((s["b"]["x"] - s["a"]["x"]) ** 2 + (s["b"]["y"] - s["a"]["y"]) ** 2)


def polyline_length(points: Column) -> Column:
    """AGG23."""
    return F.aggregate(segments(points), F.lit(0.0), lambda total, s: total + segment_length(s))


def point_at(points: Column, distance: Column) -> Column:
    """FN05: the point a distance along a polyline, clamped to its ends."""

    def step(state: Column, s: Column) -> Column:
        length = segment_length(s)
        here = state["found"].isNull() & (state["rest"] <= length)
        share = F.greatest(state["rest"], F.lit(0.0)) / F.greatest(length, F.lit(0.001))
        point = F.struct((s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * share).alias("x"), (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * share).alias("y"))
        return F.struct((state["rest"] - length).alias("rest"), F.when(here, point).otherwise(state["found"]).alias("found"))

    start = F.struct(distance.cast("double").alias("rest"), F.expr("CAST(null AS struct<x: double, y: double>)").alias("found"))
    return F.aggregate(segments(points), start, step, lambda s: F.coalesce(s["found"], F.element_at(points, -1)))


def heading_at(points: Column, distance: Column, span: float = 10.0) -> Column:
    """FN06: heading of the chord of ``span`` about a distance, clipped to the line."""
    a, b = point_at(points, distance - span / 2), point_at(points, F.least(distance + span / 2, polyline_length(points)))
    return bearing(b["x"] - a["x"], b["y"] - a["y"])


def path_heading(points: Column, distance: Column, span: float) -> Column:
    """FN08: heading of the chord of ``span`` about a distance along a path; null if the chord leaves the path or has no length."""
    half = max(1.0, span / 2)
    a, b = point_at(points, distance - half), point_at(points, distance + half)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.when((distance >= half) & (distance + half <= polyline_length(points)) & (F.sqrt(dx * dx + dy * dy) > 0.1), bearing(dx, dy))


def path_curvature(points: Column, distance: Column, span: float) -> Column:
    """FN08: change of heading per metre between two chords about a distance; null where either leaves the path."""
    apart = max(4.0, span)
    return angle_difference(path_heading(points, distance + apart / 2, apart), path_heading(points, distance - apart / 2, apart)) / apart


def project_on_polyline(points: Column, x: Column, y: Column) -> Column:
    """FN07: (error, along) of the nearest point of a polyline; the first segment wins a tie."""

    def step(state: Column, s: Column) -> Column:
        length = segment_length(s)
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        share = clamp(((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9)), F.lit(0.0), F.lit(1.0))
        error = F.sqrt((s["a"]["x"] + dx * share - x) ** 2 + (s["a"]["y"] + dy * share - y) ** 2)
        better = state["error"].isNull() | (error < state["error"])
        return F.struct(F.when(better, error).otherwise(state["error"]).alias("error"), F.when(better, state["base"] + share * length).otherwise(state["along"]).alias("along"), (state["base"] + length).alias("base"))

    start = F.struct(F.lit(None).cast("double").alias("error"), F.lit(None).cast("double").alias("along"), F.lit(0.0).alias("base"))
    return F.aggregate(segments(points), start, step, lambda s: F.struct(s["error"].alias("error"), s["along"].alias("along")))


def vehicle_axes(gravity: Column, vector: Column) -> Column:
    """FN12: (forward, lateral, up) parts of a device vector; up is against gravity, forward the device's -z made level.

    Null where the device looks along gravity (level part at most 0.45).
    """
    norm = F.sqrt(gravity[0] * gravity[0] + gravity[1] * gravity[1] + gravity[2] * gravity[2])
    up = [-gravity[i] / norm for i in range(3)]
    level = [-(F.lit(1.0 if i == 2 else 0.0)) + up[2] * up[i] for i in range(3)]
    size = F.sqrt(level[0] ** 2 + level[1] ** 2 + level[2] ** 2)
    forward = [v / size for v in level]
    right = [forward[1] * up[2] - forward[2] * up[1], forward[2] * up[0] - forward[0] * up[2], forward[0] * up[1] - forward[1] * up[0]]
    dot = lambda a: vector[0] * a[0] + vector[1] * a[1] + vector[2] * a[2]
    return F.when(size > 0.45, F.struct(dot(forward).alias("forward"), dot(right).alias("lateral"), dot(up).alias("up")))
