"""Map data, road snapping and signal work against plain Python."""

import json
import math

import pytest
from pyspark.sql import functions as F

from roadtrace.functions import geometry as geo
from roadtrace.functions import signal
from roadtrace.operators import spatial as sp
from roadtrace.sources import maps


def test_extract_and_regions(spark, tmp_path):
    elements = [
        {"type": "node", "id": 1, "lat": 50.0, "lon": 30.0}, {"type": "way", "id": 7, "nodes": [1, 2], "tags": {"highway": "primary"}},
        {"type": "relation", "id": 9, "tags": {"restriction": "no_left_turn"}, "members": [{"type": "way", "ref": 7, "role": "from"}]},
    ]
    (tmp_path / "extract.json").write_text(json.dumps({"elements": elements}, indent=1))
    nodes, ways, relations = maps.read_extract(spark, str(tmp_path / "extract.json"))
    assert [tuple(r) for r in nodes.collect()] == [(1, 30.0, 50.0)]
    assert [(r["way"], r["nodes"], r["tags"]) for r in ways.collect()] == [(7, [1, 2], {"highway": "primary"})]
    assert relations.first()["members"][0]["ref"] == 7
    region = {"id": "b", "name": "Beta", "summary": "s", "center": [50.0, 30.0], "zoom": 9, "testingStart": [50.0, 30.0]}
    (tmp_path / "r").mkdir()
    for name, value in {"b-region.json": region, "a-region.json": region | {"name": "Alpha"}, "c-region.json": region | {"center": [1.0]}, "other.json": region}.items():
        (tmp_path / "r" / name).write_text(json.dumps(value))
    (tmp_path / "r" / "d-region.json").write_text("{broken")
    assert [r["name"] for r in maps.regions(spark, str(tmp_path / "r")).collect()] == ["Alpha", "Beta"]


@pytest.mark.parametrize("change", [{}, {"id": 5}, {"length": 0.0}, {"points": [[30.0, 50.0]]}, {"points": [[30.0, 50.0], [200.0, 50.0]]}, {"points": [[30.0, 50.0], [30.0]]}])
def test_a_broken_road_rejects_the_graph(spark, tmp_path, change):
    row = {"id": 1, "way": 1, "kind": "primary", "from": 1, "to": 2, "length": 5.0, "points": [[30.0, 50.0], [30.1, 50.0]]}
    rows = [row | {"id": 0}, row | change]
    edges = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, way long, kind string, `from` long, `to` long, length double, points array<array<double>>")
    maps.write_bundle(edges, str(tmp_path), name="g", bounds=[49.0, 29.0, 51.0, 31.0], snapshot="s", projection=("stereographic", 50.0, 30.0))
    if change:
        with pytest.raises(maps.InvalidGraph):
            maps.load_graph(spark, str(tmp_path), "g")
    else:
        assert maps.load_graph(spark, str(tmp_path), "g").count() == 2


def test_manifest_rules(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, "k", 1, 2, 5.0, [[30.0, 50.0], [30.1, 50.0]])], "id long, way long, kind string, `from` long, `to` long, length double, points array<array<double>>")
    for number, (bounds, projection) in enumerate([([1.0, 2.0], None), ([1.0, 2.0, 3.0, 4.0], ("mercator", 50.0, 30.0)), ([1.0, 2.0, 3.0, 4.0], ("stereographic", 89.0, 30.0))]):
        maps.write_bundle(edges, f"{tmp_path}/{number}", name="g", bounds=bounds, snapshot="s", projection=projection)
        with pytest.raises(maps.InvalidGraph):
            maps.load_graph(spark, f"{tmp_path}/{number}", "g")


def test_snapping_projects_on_lines(spark):
    lines = [(0, [(0.0, 0.0), (1000.0, 0.0)]), (1, [(0.0, 50.0), (1000.0, 50.0), (1000.0, 400.0)]), (2, [(0.0, 50.0), (1000.0, 50.0)])]
    edges = spark.createDataFrame(lines, "id long, points array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 430.0, 10.0), (2, 500.0, 45.0), (3, 1010.0, 300.0), (4, 500.0, 300.0)], "p long, x double, y double")
    got = {r["p"]: (r["edge"], round(r["error"], 6), round(r["along"], 6)) for r in sp.nearest_road(points, edges, "p").collect()}
    assert got == {1: (0, 10.0, 430.0), 2: (1, 5.0, 500.0), 3: (1, 10.0, 1250.0)}


def test_path_heading_and_curvature(spark):
    arc = [{"x": 100 * math.cos(t / 50), "y": 100 * math.sin(t / 50)} for t in range(60)]
    df = spark.createDataFrame([(arc,)], "p array<struct<x: double, y: double>>")
    r = df.select(geo.path_curvature(F.col("p"), F.lit(60.0), 20.0).alias("c"), geo.path_heading(F.col("p"), F.lit(3.0), 20.0).alias("out"), geo.path_heading(F.col("p"), F.lit(60.0), 20.0).alias("h")).first()
    assert r["out"] is None and r["c"] == pytest.approx(-0.01, rel=0.02) and r["h"] == pytest.approx(-0.6, abs=0.02)


def test_blur_and_window(spark):
    import numpy as np

    x = [float(v) for v in np.random.default_rng(1).normal(size=40)]
    r = spark.createDataFrame([(x,)], "x array<double>").select(signal.gaussian_blur(F.col("x"), 2.0).alias("b"), signal.hann(F.col("x")).alias("h")).first()
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    assert np.allclose(r["b"], np.convolve(np.pad(x, 8, mode="edge"), w / w.sum(), mode="valid"))
    assert np.allclose(r["h"], np.array(x) * np.hanning(40))
