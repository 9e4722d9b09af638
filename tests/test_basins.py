"""Basins of a density, and suppression by rounds, against plain passes."""

import random

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import features as f
from roadtrace.operators import places as p


def _plain(v, first, dip=0.3, step=5.0):
    peaks = [i for i in range(len(v)) if v[i] > 0 and v[i] >= (v[i - 1] if i else -1) and v[i] > (v[i + 1] if i + 1 < len(v) else -1)]
    cuts, kept = [0], peaks[0] if peaks else None
    for q in peaks[1:]:
        low = min(range(kept, q + 1), key=lambda i: v[i])
        if v[low] < dip * min(v[kept], v[q]):
            cuts.append(low)
            kept = q
        elif v[q] > v[kept]:
            kept = q
    cuts.append(len(v))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        mass = sum(v[a:b])
        if mass > 0:
            mean = sum(v[i] * (first + i) * step for i in range(a, b)) / mass
            out.append((first + a, first + b - 1, mass * step, mean, max(16, sum(v[i] * ((first + i) * step - mean) ** 2 for i in range(a, b)) / mass + step * step / 12)))
    most = max((o[2] for o in out), default=0)
    return sorted(o for o in out if o[2] >= 1e-3 * most)


def test_basins(spark, monkeypatch):
    monkeypatch.setattr(f, "ROWS", 7)
    rnd = random.Random(4)
    shapes = {0: [0.0] * 12, 1: [1, 1, 1], 2: [5, 4, 1, 4, 0.5, 6, 0.1, 3, 3, 0], 3: [9, 0.001, 0.0001, 0, 0, 0.002], 4: [2.0]}
    shapes |= {k: [max(0.0, rnd.choice([0, 0, 1, 1, 2, 5]) * rnd.random()) for _ in range(rnd.randint(1, 60))] for k in range(5, 25)}
    rows = [(k, 10 * k - 30 + i, float(x)) for k, v in shapes.items() for i, x in enumerate(v)]
    got = {}
    for r in f.basins(spark.createDataFrame(rows, "k long, c long, v double").repartition(3), "k", "c", "v").collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    for k, v in shapes.items():
        want = _plain(v, 10 * k - 30)
        have = sorted(got.get(k, []))
        assert len(have) == len(want), k
        for a, b in zip(have, want, strict=True):
            assert a == pytest.approx(b)


def test_suppression_by_rounds(spark):
    """Dense groups, ties of the order, equal places, rows without a place."""
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(40), rnd.uniform(-30, 30), rnd.uniform(-9, 9)) for _ in range(500)] + [("a", 0, 1.0, 1.0)] * 3 + [("a", 1, None, 1.0), ("b", 2, float("nan"), 0.0), (None, 3, 0.0, 0.0), (None, 4, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "kind string, rank int, x double, y double").withColumn("id", F.monotonically_increasing_id()).cache()
    kept = []
    for r in sorted(df.collect(), key=lambda r: (r["rank"], r["id"])):
        placed = r["x"] is not None and r["x"] == r["x"]
        if not placed or all(q["kind"] != r["kind"] or q["x"] is None or not (q["x"] - r["x"]) ** 2 + (q["y"] - r["y"]) ** 2 <= 16 for q in kept):
            kept.append(r)
    assert sorted(r["id"] for r in p.suppressed(df, ["kind"], ["rank", "id"], 4.0).collect()) == sorted(r["id"] for r in kept)
    assert p.suppressed(df.limit(0), ["kind"], ["rank"], 4.0).count() == 0
