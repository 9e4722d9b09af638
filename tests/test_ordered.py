import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadtrace.operators import ordered as o
from roadtrace.streaming import live

rnd = random.Random(3)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, rnd.randint(0, 400), i, float(rnd.randint(0, 50))) for i, k in enumerate(rnd.choices("aab", k=300))]
    return spark.createDataFrame(data, "k string, t long, i long, v double").cache(), data


@pytest.mark.parametrize("size", [1, 50, 10_000])
def test_buckets_do_not_show(rows, size):
    """Previous rows, running sums and islands are the same however time is cut."""
    df, data = rows
    bucket = F.floor(F.col("t") / size)
    want = []
    for k in "ab":
        last, total, island = None, 0.0, 0
        for _, t, i, v in sorted((r for r in data if r[0] == k), key=lambda r: r[1:3]):
            total += v
            island += last is None or t - last > 5
            want.append((k, i, last, total, island))
            last = t
    before = o.with_previous(df, ["k"], ["t", "i"], ["t"], bucket)
    run = o.running_sum(before, ["k"], ["t", "i"], F.col("v"), bucket, "total")
    got = run.select("k", "i", F.col("previous.t").alias("p"), "total").join(o.islands(df, ["k"], "t", "i", 5, bucket).select("i", "island"), "i")
    assert sorted((r["k"], r["i"], r["p"], r["total"], r["island"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("size", [1, 60, 10_000])
def test_asof_and_interpolation(rows, spark, size):
    df, data = rows
    probes = spark.createDataFrame([(k, t, 0) for k in "ab" for t in range(-5, 410, 15)], "k string, t long, i long")
    bucket = F.floor(F.col("t") / size)
    held = {(r["k"], r["t"]): r["held"] for r in o.hold_last(probes, df, ["k"], "t", ["i", "v"], bucket, tie="i").collect()}
    between = {(r["k"], r["t"]): r["v"] for r in o.interpolated(probes, df, ["k"], "t", "v", bucket, tie="i").collect()}
    for (k, t), h in held.items():
        own = sorted(r[1:] for r in data if r[0] == k)
        upto, later = [r for r in own if r[0] <= t], [r for r in own if r[0] >= t]
        assert (h["i"], h["v"]) == upto[-1][1:] if upto else h is None
        if upto and later:
            a, b = upto[-1], later[0]
            assert between[k, t] == pytest.approx(a[2] + (b[2] - a[2]) * (t - a[0]) / (b[0] - a[0]) if b[0] > a[0] else a[2])
        else:
            assert between[k, t] is None


@pytest.mark.parametrize(("size", "block"), [(7, 3), (60, 16), (10_000, 32_768)])
def test_throttle_counts_from_the_last_kept(spark, monkeypatch, size, block):
    monkeypatch.setattr(o, "BLOCK", block)
    bucket = F.floor(F.col("t") / size)
    df = spark.createDataFrame([("d", t, i) for i, t in enumerate([0, 4, 10, 19, 20, 31])], "k string, t long, i long")
    assert [(r["t"], r["suppressed"]) for r in o.throttle(df, ["k"], "t", "i", 10, bucket).orderBy("t").collect()] == [(0, 0), (10, 1), (20, 1), (31, 0)]
    data = [(k, rnd.randint(0, 600), i) for i, k in enumerate(rnd.choices("aab", k=400))]
    want = []
    for k in "ab":
        last, dropped = None, 0
        for _, t, i in sorted((r for r in data if r[0] == k), key=lambda r: r[1:]):
            if last is None or t - last >= 23:
                want.append((k, t, i, dropped))
                last, dropped = t, 0
            else:
                dropped += 1
    got = o.throttle(spark.createDataFrame([*data, ("a", None, 900)], "k string, t long, i long"), ["k"], "t", "i", 23, bucket)
    assert sorted(map(tuple, got.select("k", "t", "i", "suppressed").collect())) == sorted(want)


def test_rolling_and_partial_integrals(rows, spark):
    df, data = rows
    got = {r["i"]: (r["n"], r["s"]) for r in o.rolling(df, ["k"], "t", 37, {"n": lambda w: F.count("*").over(w), "s": lambda w: F.sum("v").over(w)}).collect()}
    for k, t, i, _ in data:
        back = [v for k2, u, _, v in data if k2 == k and t - 37 <= u <= t]
        assert got[i] == (len(back), sum(back))
    steps = [("a", 0, 10, 2.0, 0), ("a", 10, 15, -1.0, 1), ("a", 40, 50, 3.0, 2), ("b", 5, 6, 4.0, 3)]
    at = [("a", -1), ("a", 0), ("a", 4), ("a", 12), ("a", 30), ("a", 45), ("a", 90), ("b", 6)]
    for size in (1, 20, 1000):
        held = o.integrated(spark.createDataFrame(at, "k string, t long"), spark.createDataFrame(steps, "k string, t long, end long, v double, i long"), ["k"], "t", "v", F.floor(F.col("t") / size), tie="i")
        assert {(r["k"], r["t"]): r["integral"] for r in held.collect()} == dict(zip(at, [None, 0, 8, 18, 15, 30, 45, 4], strict=True))


def test_thinning(spark):
    df = spark.createDataFrame([("d", i, float(x), 0.0) for i, x in enumerate([0, 1, 2, 2.5, 4, 5, 9])], "k string, i long, x double, y double")
    assert [r["x"] for r in o.thin(df, ["k"], ["i"], ("x", "y"), 2.0).orderBy("i").collect()] == [0, 2.5, 5, 9]


def test_stream_equals_batch_over_ordered_files(spark, tmp_path):
    data = pd.DataFrame({"k": [("a", "b", "b")[i % 3] for i in range(90)], "t": [i * 7 % 13 + 5 * i for i in range(90)], "i": range(90)}).sort_values(["t", "i"])
    for n in range(3):
        spark.createDataFrame(data.iloc[n * 30 : n * 30 + 30]).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    schema = "k string, t long, i long"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = live.run_to_end(live.throttled(stream, "k", "t", "i", 20), f"{tmp_path}/out").select("k", "t", "i", "suppressed")
    want = o.throttle(spark.createDataFrame(data, schema), ["k"], "t", "i", 20, F.floor(F.col("t") / 50)).select("k", "t", "i", "suppressed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
