import gzip
import json

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import graph as g
from roadtrace.operators import search as s
from roadtrace.operators import spatial as sp
from roadtrace.operators.components import components
from roadtrace.sources import recordings as r


def test_map_extract_to_graph(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(1, 8)], "id long, x double, y double")
    ways = spark.createDataFrame(
        [(10, [1, 2, 3], {"highway": "residential"}), (20, [5, 2, 6], {"highway": "primary", "oneway": "yes"}), (30, [3, 99], {"highway": "service"}), (40, [4, 7], {"highway": "tertiary", "oneway": "-1"}), (50, [1, 4], {"highway": "footway"}), (60, [6, 7], {"highway": "primary", "vehicle": "no"})],
        "way long, nodes array<long>, tags map<string,string>",
    )
    kept = ways.filter(g.drivable(F.col("tags")))
    assert sorted(x["way"] for x in kept.collect()) == [10, 20, 30, 40]
    edges = g.split_ways(kept, nodes)
    got = [(x["id"], x["way"], x["from"], x["to"], len(x["points"])) for x in edges.orderBy("id").collect()]
    assert got == [(0, 10, 1, 2, 2), (1, 10, 2, 1, 2), (2, 10, 2, 3, 2), (3, 10, 3, 2, 2), (4, 20, 5, 2, 2), (5, 20, 2, 6, 2), (6, 40, 7, 4, 2)]
    member = lambda role, kind, ref: (kind, ref, role)
    relations = spark.createDataFrame(
        [({"restriction": "no_left_turn"}, [member("from", "way", 10), member("via", "node", 2), member("to", "way", 20)]), ({"restriction": "only_straight_on", "except": "motorcar"}, [member("from", "way", 20), member("via", "node", 2), member("to", "way", 10)])],
        "tags map<string,string>, members array<struct<type: string, ref: long, role: string>>",
    )
    rules = g.restrictions(relations, kept)
    assert [tuple(x) for x in rules.collect()] == [(2, 10, 20, False, True)]
    pairs = sorted((x["edge"], x["next"]) for x in g.successors(edges, rules).collect())
    assert pairs == [(0, 2), (3, 1), (4, 1), (4, 2), (4, 5)]


def test_chains_and_cycles(spark):
    links = [(i, i + 1) for i in range(10)] + [(20, 21), (20, 22), (30, 31), (31, 30)]
    got = {x["edge"]: (x["chain"], x["place"]) for x in g.chains(spark.createDataFrame(links, "edge long, next long")).collect()}
    assert all(got[i] == (0, i) for i in range(11)) and got[21] == (21, 0) and got[30] == (30, 0) and got[31] == (31, 0)


def test_routes(spark):
    turns = spark.createDataFrame([(0, 1), (1, 3), (3, 5)], "edge long, next long")
    routes = spark.createDataFrame([("a", i, e, 100.0) for i, e in enumerate((0, 1, 3, 5))] + [("b", 0, 0, 50.0), ("b", 1, 5, 50.0)], "route string, seq int, edge long, length double")
    assert {x["route"]: x["valid"] for x in g.valid_routes(routes, turns).collect()} == {"a": True, "b": False}
    probes = spark.createDataFrame([("a", -1.0), ("a", 120.0), ("a", 200.0), ("a", 401.0)], "route string, offset double")
    assert sorted((x["offset"], x["edge"], x["along"]) for x in g.edge_at(g.route_offsets(routes, "length"), probes).collect()) == [(120, 1, 20), (200, 1, 100)]


def test_spatial_against_all_pairs(spark):
    import random

    rnd = random.Random(5)
    pts = [(i, i % 3, rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, name int, x double, y double")
    far = lambda a, b: ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5
    near = {x["id"]: x["rid"] for x in sp.nearest(df.filter("name = 0"), df.filter("name = 1").withColumnRenamed("id", "rid"), "id", "rid", 12, 5).collect()}
    for a in pts[::3]:
        b = min((p for p in pts if p[1] == 1), key=lambda p: (far(a, p), p[0]))
        assert near.get(a[0]) == (b[0] if far(a, b) < 12 else None)
    label = {p[0]: p[0] for p in pts}
    for a in pts:
        for b in pts:
            if a[1] == b[1] and far(a, b) <= 9 and label[a[0]] != label[b[0]]:
                old, new = max(label[a[0]], label[b[0]]), min(label[a[0]], label[b[0]])
                label = {k: new if v == old else v for k, v in label.items()}
    assert {x["id"]: x["cluster"] for x in sp.clusters(df, "id", "name", 9).collect()} == label


def test_components_of_a_long_path(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")).collect()
    assert {x["label"] for x in got if x["node"] <= 100} == {0} and {x["label"] for x in got if x["node"] > 100} == {500}


def test_search_falls_back_to_typos(spark):
    entries = spark.createDataFrame([(1, "Main Street", "Lviv", 0, 2.0), (2, "Maine Court", "Kyiv", 1, 1.0), (3, "Harbour", "Main Bay", 0, 0.0)], "entry long, name string, context string, rank int, km double")
    index = s.postings(entries, "entry", ["name", "context"])
    assert [x["entry"] for x in s.search(index, entries, "main", 2).collect()] == [1, 2]
    assert [x["entry"] for x in s.search(index, entries, "harbor main", 2).collect()] == [3]
    assert s.search(index, entries, "zzzzzz").collect() == []


def row(kind, n, **payload):
    return json.dumps({"kind": kind, "sequence": n, "unknown": 1, **payload}, separators=(",", ":"))


def sample(n):
    return row("sample", n, sample={"time": n / 10, "yawRate": 0.1})


def test_recordings(spark, tmp_path):
    head = row("header", 1, header={"version": 4, "snapshot": "s", "mapHash": "h", "previousRecording": "older.jsonl.gz"})
    (tmp_path / "whole.jsonl").write_text("\n".join([head, *(sample(n) for n in range(2, 50)), row("footer", 50, event="done")]) + "\n")
    (tmp_path / "torn.jsonl").write_text(row("header", 1, header={"version": 2}) + "\n" + sample(2)[:20])
    with gzip.open(tmp_path / "older.jsonl.gz", "wt") as f:
        f.write(row("header", 1, header={"version": 5, "snapshot": "s", "mapHash": "h"}) + "\n" + sample(2) + "\n")
    got = r.read_recordings(spark, str(tmp_path)).cache()
    sums = {x["drive"]: x for x in r.summary(got).collect()}
    assert (sums["whole"]["n"], sums["whole"]["finish"], sums["whole"]["last"]) == (50, "done", 4.9)
    assert sums["torn"]["n"] == 1 and sums["older"]["n"] == 2
    heads = r.headers(got)
    assert {x["drive"]: x["reason"] for x in r.compatible(heads, "s", "h").collect()} == {"whole": None, "torn": "snapshot", "older": "version"}
    assert sorted((x["drive"], x["ancestor"], x["step"]) for x in r.previous_chain(heads).filter("step > 0").collect()) == [("whole", "older", 1)]
    assert r.replayed(got).groupBy("kind").count().collect()[0]["kind"] == "sample"


@pytest.mark.parametrize("text", [f"{sample(1)}\nbroken\n{sample(3)}\n", f"{sample(1)}\nbroken\n", f"{sample(1)}\n\n{sample(3)}\n"])
def test_damage_inside_is_refused(spark, tmp_path, text):
    (tmp_path / "bad.jsonl").write_text(text)
    with pytest.raises(r.DamagedRecording):
        r.read_recordings(spark, str(tmp_path))
    kept = r.read_recordings(spark, str(tmp_path), salvage=True)
    assert {x["warning"] for x in kept.collect()} == {"1 damaged rows"}
