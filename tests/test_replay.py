import json
import math
import random
from datetime import datetime

import numpy as np
import pytest

from roadtrace.functions import signal
from roadtrace.operators import features as f
from roadtrace.sources import recordings as r

rnd = random.Random(11)


def test_credible_radius_is_the_bisected_one(spark):
    mixes = {k: [(rnd.uniform(0.1, 1), rnd.uniform(-spread, spread), rnd.uniform(0, 400)) for _ in range(12)] for k, spread in (("a", 30), ("b", 900), ("c", 6000))}
    want = {}
    for k, parts in mixes.items():
        total = sum(w for w, _, _ in parts)
        held = lambda rad: sum(w / total * 0.5 * (math.erf((5 + rad - o) / math.sqrt(2 * max(1, v))) - math.erf((5 - rad - o) / math.sqrt(2 * max(1, v)))) for w, o, v in parts)  # noqa: B023, E731
        low, high = 0.0, 1000.0
        while held(high) < 0.95 and high < 4000:
            high *= 2
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (low, middle) if held(middle) >= 0.95 else (middle, high)
        want[k] = high
    rows = [(k, w / sum(p[0] for p in parts), o, v) for k, parts in mixes.items() for w, o, v in parts]
    got = f.credible_radius(spark.createDataFrame(rows, "k string, weight double, offset double, variance double"), spark.createDataFrame([(k, 5.0, 2000.0) for k in mixes], "k string, centre double, length double"), "k")
    assert {q["k"]: q["radius"] for q in got.collect()} == pytest.approx(want, abs=1e-6)


def test_vibration_level(spark):
    data = [("a", i, math.sin(i / 3) * 4 + rnd.gauss(0, 1), rnd.gauss(0, 2)) for i in range(130)] + [("b", i, 1.0, 2.0) for i in range(20)]
    got = f.vibration_level(spark.createDataFrame(data, "k string, i long, x double, y double"), "k", "i", ["x", "y"], size=50, hop=30, transform=64)
    want = {}
    for w in range(3):
        part = np.array([d[2:] for d in data[w * 30 : w * 30 + 50]])
        power = np.abs(np.fft.fft((part - part.mean(axis=0)) * np.hanning(50)[:, None], 64, axis=0)) ** 2
        want["a", w] = float(np.mean([np.log10(np.median([power[b, c] for b in range(2, 29)]) + 1e-14) for c in (0, 1)]))
    assert {(q["k"], q["window"]): q["level"] for q in got.collect()} == pytest.approx(want)


def test_distance_samples(spark):
    steady, braking = [0.0] * 40, [-0.05 * i for i in range(40)]
    rows = [(0, steady, 10.0), (1, braking, 10.0), (2, braking, 0.5), (3, None, 10.0), (4, [], 10.0), (5, braking, None)]
    got = {q["i"]: q["p"] for q in spark.createDataFrame(rows, "i int, v array<double>, now double").select("i", signal.distance_samples("v", "now").alias("p")).collect()}
    assert [got[i] for i in (0, 2, 3, 4, 5)] == [None] * 5
    # A braking car covers more road early: positions lag before the centre and lead after it.
    assert got[1][20] == 20 and all(b > a for a, b in zip(got[1][1:-1], got[1][2:], strict=False)) and got[1][39] == 39
    assert got[1][5] > 5 and got[1][30] > 30


def test_files_and_references(spark, tmp_path):
    for name in ("b.jsonl", "a.jsonl", "c.jsonl.gz", "note.txt"):
        (tmp_path / name).write_bytes(b"{}")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.jsonl").write_bytes(b"{}")
    assert [q["path"].rsplit("/", 1)[1] for q in r.recording_files(spark, str(tmp_path)).collect()] == ["a.jsonl", "b.jsonl", "c.jsonl.gz", "d.jsonl"]
    assert [q["name"] for q in r.reference_files(spark, str(tmp_path)).collect()] == ["a.jsonl", "b.jsonl"]
    one = spark.createDataFrame([(datetime(2024, 5, 6, 7, 8, 9), 50.1)], "observedAt timestamp_ntz, latitude double")
    path = r.save_reference(one, str(tmp_path / "refs"), metadata={"car": "x"}, snapshot="s1")
    assert "Reference_2024-05-06_07-08-09_" in path
    (text,) = (q["value"] for q in spark.read.text(path).collect())
    entry = json.loads(text)
    assert entry["kind"] == "field-reference" and entry["reference"]["latitude"] == 50.1 and entry["details"] == {"car": "x", "mapSnapshot": "s1", "formatVersion": "3"}


def test_raw_replay_ends_after_the_first_late_frame(spark):
    rows = [(1, "raw", 0.0, None), (2, "header", None, None), (3, "sample", None, None), (4, "raw", 10.0, None), (5, "calibration", None, "reused"), (6, "calibration", None, "new"), (7, "raw", 12.0, None), (8, "event", None, None), (9, "raw", 15.5, None), (10, "event", None, None), (11, "raw", 11.0, None)]
    df = spark.createDataFrame([("d", s, k, None if t is None else (t,), None if c is None else {"reason": c}) for s, k, t, c in rows], "drive string, sequence long, kind string, raw struct<time: double>, details map<string,string>")
    assert [q["sequence"] for q in r.raw_replay(df, 5).orderBy("sequence").collect()] == [2, 4, 5, 7, 8]
    assert [q["sequence"] for q in r.raw_replay(df, 50).orderBy("sequence").collect()] == [2, 4, 5, 7, 8, 9, 10, 11]
