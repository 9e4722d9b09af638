"""Row validity, quality flags and gates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flags(rules: list[tuple[str, Column]]) -> Column:
    """FLT09: array of the names whose condition holds, in order; a null condition doesn't hold."""
    return F.filter(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules)), lambda x: x.isNotNull())


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """FLT10: name of the first rule that holds, else null (accepted)."""
    return F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules))


def finite(value: Column) -> Column:
    """FLT02: neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def valid_raw(acceleration: Column, rotation: Column, gravity: Column) -> Column:
    """FLT01: three finite components each, and a gravity of about one g."""
    vectors = [(F.size(v) == 3) & F.forall(v, finite) for v in (acceleration, rotation, gravity)]
    norm = F.sqrt(F.aggregate(gravity, F.lit(0.0), lambda s, x: s + x * x))
    return vectors[0] & vectors[1] & vectors[2] & (norm > 0.5) & (norm < 1.5)


def gps_flags(fix: Column) -> Column:
    """FLT09 for position fixes: the thirteen flags of a fix in their order.

    ``fix`` has latitude, longitude, timestamp, age, horizontal, altitude, vertical, speed, speed_accuracy, course, course_accuracy and
    the booleans reduced, simulated and accessory; a missing age tells nothing, other missing numbers are invalid.
    """
    number = lambda name: finite(fix[name])
    bad = lambda name: ~number(name) | (fix[name] < 0)
    speed, accuracy = bad("speed") | bad("speed_accuracy"), bad("horizontal")
    return flags([
        ("invalid_coordinate", ~number("latitude") | ~number("longitude") | (F.abs(fix["latitude"]) > 90) | (F.abs(fix["longitude"]) > 180)),
        ("invalid_timestamp", ~number("timestamp")), ("stale_fix", fix["age"] > 3), ("future_fix", fix["age"] < -1),
        ("invalid_horizontal_accuracy", accuracy), ("poor_horizontal_accuracy", ~accuracy & (fix["horizontal"] > 25)),
        ("invalid_altitude", bad("vertical") | ~number("altitude")),
        ("invalid_speed", speed), ("poor_speed_accuracy", ~speed & (fix["speed_accuracy"] > 3)),
        ("invalid_course", bad("course") | (fix["course"] >= 360) | bad("course_accuracy")),
        ("reduced_accuracy", fix["reduced"]), ("software_simulation", fix["simulated"]), ("accessory_source", fix["accessory"]),
    ])


def vibration_gate(speed: Column, wheelbase: Column) -> Column:
    """FLT10: why a vibration speed is refused, or null."""
    return first_reason([("not_finite", ~finite(speed) | ~finite(wheelbase)), ("speed_range", (speed < 0) | (speed > 45)), ("wheelbase", wheelbase <= 0)])


def visual_gate(speed: Column, sigma: Column, quality: Column) -> Column:
    """FLT10: why a camera speed is refused, or null."""
    return first_reason([("not_finite", ~finite(speed) | ~finite(sigma) | ~finite(quality)), ("speed_range", (speed < 0) | (speed > 55)), ("sigma_range", (sigma < 1) | (sigma > 20)), ("quality_range", (quality < 0.2) | (quality > 1))])
