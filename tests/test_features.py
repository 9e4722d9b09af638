import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtrace.functions import motion as m
from roadtrace.operators import features as f
from roadtrace.operators import places as p
from roadtrace.operators import routing as r

rnd = random.Random(11)


def test_spectrum_is_welch(spark):
    x = np.sin(np.arange(300) * 0.7) + np.array([rnd.random() for _ in range(300)])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, 1.0) for i in range(10)], "k string, i long, v double")
    got = sorted((q["bin"], q["power"], q["windows"]) for q in f.spectrum(df, "k", "i", "v", 64).collect())
    window, parts = np.hanning(64), []
    for lo in range(0, 300 - 63, 32):
        d = np.abs(np.fft.rfft((x[lo : lo + 64] - x[lo : lo + 64].mean()) * window)) ** 2 / (window**2).sum()
        d[1:-1] *= 2
        parts.append(d)
    assert [g[0] for g in got] == list(range(33)) and {g[2] for g in got} == {len(parts)}
    assert np.allclose([g[1] for g in got], np.mean(parts, axis=0))


def test_bends_and_downsampling(spark):
    turns = spark.createDataFrame([("r", float(a), d) for a, d in ((0, 0.5), (10, 0.5), (40, -0.6), (45, 0.01), (60, -0.3), (100, 0.05))], "k string, at double, d double")
    got = [(b["begin"], b["end"], round(b["angle"], 6), b["middle"]) for b in f.bends(turns, "k", "at", "d", 0.02, 15, 0.3).orderBy("begin").collect()]
    assert got == [(0, 10, 1.0, 0), (40, 40, -0.6, 40), (60, 60, -0.3, 60)]
    rows = spark.createDataFrame([("d", i * 0.02, float(i)) for i in range(11)], "k string, t double, v double")
    for size in (0.07, 10.0):
        out = f.downsampled(rows, "k", "t", ["v"], 0.05, F.floor(F.col("t") / size)).orderBy("t").collect()
        assert [(round(q["t"], 2), round(q["v"], 6)) for q in out] == [(0.06, 2.0), (0.12, 5.0), (0.18, 8.0)]


def test_turn_likelihood(spark):
    one = lambda s, y, a: spark.range(1).select(m.turn_likelihood(F.lit(s), F.lit(y), F.lit(a)).alias("v")).first()["v"]
    yaw = np.radians(14.8)
    assert one(30 / 3.6, float(yaw), 2.15) > 0.95 and one(110 / 3.6, float(yaw), 2.15) < 0.02 and one(50.0, 0.05, 9.0) == 1


def test_suppression_is_greedy(spark):
    pts = [(i, i % 2, rnd.uniform(0, 40), rnd.uniform(0, 40)) for i in range(80)]
    kept = []
    for a in pts:
        if all(b[1] != a[1] or (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 > 49 for b in kept):
            kept.append(a)
    df = spark.createDataFrame(pts, "id long, kind int, x double, y double")
    assert sorted(q["id"] for q in p.suppressed(df, ["kind"], ["id"], 7).collect()) == [k[0] for k in kept]


def test_settlement_search_widens(spark, monkeypatch):
    pts = spark.createDataFrame([(1, "x", 0.0, 0.0), (2, "x", 900.0, 900.0)], "id long, kind string, x double, y double")
    towns = spark.createDataFrame([(7, "city", 30.0, 0.0), (8, "village", 20.0, 0.0)], "id long, kind string, x double, y double")
    for limit in (10_000, 0):
        monkeypatch.setattr(p, "BROADCAST", limit)
        assert {q["id"]: q["place"] for q in p.nearest_settlement(pts, towns, 50, {"city": 15.0}).collect()} == {1: 7, 2: 7}


def test_routes_and_alternatives(spark):
    # 0 -> 1 -> 4 long, 0 -> 3 -> 4 straight, 0 -> 2 -> 4 between.
    edges = spark.createDataFrame([(0, 10.0), (1, 30.0), (2, 24.0), (3, 20.0), (4, 10.0), (9, 1.0)], "id long, cost double")
    turns = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4), (2, 4), (3, 4), (4, 0)], "edge long, next long")
    asked = spark.createDataFrame([("a", 0, 4), ("b", 3, 1), ("c", 0, 9), ("d", 4, 4)], "request string, start long, goal long")
    got = {q["request"]: (q["cost"], q["route"]) for q in r.shortest(edges, turns, asked).collect()}
    assert got == {"a": (30, [0, 3, 4]), "b": (40, [3, 4, 0, 1]), "d": (0, [4])}
    options = r.alternatives(edges, turns, asked.filter("request = 'a'"), rounds=3)
    assert [(q["option"], q["cost"], q["route"]) for q in options.orderBy("option").collect()][:2] == [(1, 30, [0, 3, 4]), (2, 34, [0, 2, 4])]


def test_banded_evidence_and_peaks(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0)] * 20 + [(1, 15.0, 4.0)] * 5 + [(2, 5.0, 1.0)], "ratio int, speed double, score double")
    assert sorted(map(tuple, f.banded_evidence(df, "ratio", "speed", "score", 3, 10.0).collect())) == [(1, pytest.approx(3.0), 1, 25), (2, 1.0, 0, 1)]
    line = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate((1, 3, 3, 2, 5))], "k string, i int, v double")
    assert [q["i"] for q in f.peaks(line, "k", "i", "v").orderBy("i").collect()] == [1, 4]


def test_drag_stays_on_its_road(spark):
    """A road north, one on from its end, one right from its end, and an unconnected parallel."""
    from roadtrace.operators import spatial as sp

    line = lambda *p: [(float(x), float(y)) for x, y in p]
    edges = spark.createDataFrame([(0, 1, 2, line((0, 0), (0, 200))), (1, 2, 3, line((0, 200), (0, 1400))), (2, 2, 4, line((0, 200), (1000, 200))), (4, 8, 9, line((15, 0), (15, 200)))], "id long, start long, end long, points array<struct<x: double, y: double>>")
    moves = spark.createDataFrame([("stay", 0, 15.0, 80.0, 0.0, 60.0, 2, 140.0), ("turn", 0, 30.0, 205.0, 0.0, 190.0, 2, 10.0), ("far", 0, 500.0, 500.0, 0.0, 60.0, 2, 140.0)], "move string, edge long, x double, y double, from_x double, from_y double, node long, node_distance double")
    got = {q["move"]: (q["edge"], q["along"]) for q in sp.drag(moves, edges).collect()}
    assert got == {"stay": (0, 80.0), "turn": (2, 30.0)}


def test_routes_through_stops_and_distinct_bends(spark):
    edges = spark.createDataFrame([(i, 1.0) for i in range(6)], "id long, cost double")
    turns = spark.createDataFrame([(i, (i + 1) % 6) for i in range(5)] + [(1, 4)], "edge long, next long")
    stops = spark.createDataFrame([("a", 0, 0), ("a", 1, 2), ("a", 2, 5), ("b", 0, 3), ("b", 1, 0)], "request string, seq int, edge long")
    assert [tuple(q) for q in r.through(edges, turns, stops).collect()] == [("a", 5.0, [0, 1, 2, 3, 4, 5])]
    bends = spark.createDataFrame([("r", 10.0, 0.4), ("r", 15.0, 0.9), ("r", 20.0, -0.5), ("r", 40.0, -0.1)], "k string, middle double, angle double")
    assert sorted(q["middle"] for q in f.distinct_bends(bends, "k", 8).collect()) == [15, 20, 40]
