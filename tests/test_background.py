import random

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import features as f

rnd = random.Random(4)


@pytest.mark.parametrize("block,day", [(1, 50), (7, 50), (7, 10_000), (4096, 50)])
def test_blocks_do_not_show(spark, monkeypatch, block, day):
    monkeypatch.setattr(f, "BLOCK", block)
    data = [(k, rnd.randint(0, 400), i, rnd.uniform(-5, 50)) for i, k in enumerate(rnd.choices("aab", k=300))]
    want = {}
    for k in "ab":
        b = None
        for _, _, i, v in sorted((r for r in data if r[0] == k), key=lambda r: r[1:3]):
            b = v if b is None else (1 - 1 / 20) * b + v / 20
            want[i] = b
    df = spark.createDataFrame(data, "k string, t long, i long, v double")
    got = f.background(df, "k", ["t", "i"], "v", 20, F.floor(F.col("t") / day))
    assert got.columns == [*df.columns, "background"]
    assert {r["i"]: r["background"] for r in got.collect()} == pytest.approx(want)
