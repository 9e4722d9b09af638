"""Whitening against plain numpy and exact whole numbers; refinement of clustered eigenvalues; defined cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadtrace.llm import whitening as wh
from roadtrace.llm.queries import op12_embedding_whitening


def _plain(rows):
    """{vec_id: [(component, n, deviation, whitened, explained)]} by exact sums and a double decomposition."""
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in whole})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    mean = [Fraction(s, n) for s in sums]
    centred = [[float(x[i] - mean[i]) for i in range(d)] for x in fit]
    values, vectors = np.linalg.eigh(np.array(centred).T @ np.array(centred) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in whole:
        at = np.array([float(v - m) for v, m in zip(x, mean, strict=True)])
        out[i] = [(k + 1, n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), float(at @ vectors[:, k] / math.sqrt(values[k])), values[k] / values.sum()) for k in range(min(4, d))]
    return out


def test_op12_equals_a_plain_whitening(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    wanted = _plain([(r[0], r[1]) for r in rows])
    got = {}
    for r in op12_embedding_whitening(spark, "/root/testdata/sf0.001").orderBy("vec_id", "component").collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert got.keys() == wanted.keys()
    signs = [1 if a["whitened"] * b[3] > 0 else -1 for a, b in zip(got[rows[0][0]], wanted[rows[0][0]], strict=True)]
    for i, want in wanted.items():
        for sign, a, b in zip(signs, got[i], want, strict=True):
            assert (a["component"], a["n"], a["deviation"]) == b[:3]
            assert a["whitened"] == pytest.approx(sign * b[3], rel=1e-9, abs=1e-9) and a["explained"] == pytest.approx(b[4], rel=1e-9)
            assert a["identity_error"] < 1e-9


@pytest.mark.parametrize("values", [[9, 4, 1, 0.5], [5, 5, 5, 1], [7, 7 + 1e-9, 2, 2, 2, 1], [3.0] * 6, [1e6, 1, 1e-6, 0]])
def test_refinement_reaches_double_precision_also_in_clusters(values):
    rng = np.random.default_rng(3)
    turn, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = (turn.astype(wh.WIDE) * np.array(values, wh.WIDE)) @ turn.T.astype(wh.WIDE)
    matrix = (matrix + matrix.T) / 2
    found, vectors = wh.eigenvectors(matrix)
    size = max(values)
    assert np.allclose(found.astype(float), sorted(values, reverse=True), rtol=0, atol=1e-15 * size * 4)
    assert float(np.abs(vectors.T @ vectors - np.eye(len(values))).max()) < 1e-15
    assert float(np.abs(matrix @ vectors - vectors * found).max()) < 4e-15 * size


def test_refinement_beats_the_float32_start():
    rng = np.random.default_rng(5)
    matrix = np.cov(rng.normal(size=(40, 300)))
    start = np.linalg.eigh(matrix.astype(np.float32))[1]
    assert np.abs(start.T @ matrix @ start - np.diag(np.diag(start.T @ matrix @ start))).max() > 1e-9
    found, vectors = wh.eigenvectors(matrix.astype(wh.WIDE))
    assert float(np.abs(matrix @ vectors - vectors * found).max()) < 1e-14


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-0.001, 0.0]), (7, [3.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("weight", F.lit(1)).repartition(3)
    out = wh.transform(table, wh.fit(table)).collect()
    plain = _plain([(i, r) for i, r in enumerate([[1.0, 2.0], [-0.001, 0.0], [3.0, 0.0], [0.0, 0.0]])])
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in out) == sorted((str(i), c, 4) for i in (1, 1, None, 6, 7, 8) for c in (1, 2))
    assert {r["deviation"] for r in out if r["vec_id"] == 7} == {plain[2][0][2]}
    # Empty tables, tables without a whole vector, clashing names, no variance.
    assert wh.transform(table.limit(0), wh.fit(table.limit(0))).count() == 0
    assert wh.transform(table, wh.fit(table.filter("vec_id = 2"))).count() == 0
    with pytest.raises(ValueError):
        wh.transform(table.withColumn("n", F.lit(1)), None)
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3, "vec_id long, embedding array<float>")
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in wh.transform(one, wh.fit(one)).collect()} == {(1, 0, 0.0, 0.0, 0.0)}
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["component"], round(abs(r["whitened"]), 9)) for r in wh.transform(two, wh.fit(two)).collect()) == [(1, 1.0)] * 2 + [(2, 0.0)] * 2 + [(3, 0.0)] * 2


def test_large_entries_and_any_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)) * [9e11, 4e11, 2e11, 1e11, 3e10])] + [(300, [1e300, -1e300, 0.0, 1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert wh.transform(table, wh.fit(table)).filter("whitened is null").count() == 0
    near = table.filter("vec_id < 300")
    wanted = _plain(rows[:300])
    models = [wh.fit(near.repartition(k)) for k in (1, 7)]
    assert models[0].n == models[1].n and (models[0].vectors == models[1].vectors).all() and models[0].trace == models[1].trace
    for r in wh.transform(near, models[0]).collect():
        want = wanted[r["vec_id"]][r["component"] - 1]
        assert r["deviation"] == (want[2] if want[2] < 1 << 63 else None) and abs(r["whitened"]) == pytest.approx(abs(want[3]), rel=1e-6)


def test_large_shift_loses_nothing(spark):
    """A common offset of 2**40 steps leaves the covariance as it is."""
    rng = np.random.default_rng(2)
    base = np.floor(rng.normal(size=(200, 4)) * 256) / 256
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base + shift)], "vec_id long, embedding array<double>") for shift in (0.0, 2.0**32)]
    a, b = (wh.fit(f) for f in frames)
    assert (a.vectors == b.vectors).all() and (a.values == b.values).all()
