"""Graph operators whose rows between stages must not grow with turns, walks or pairs."""

import random

from pyspark.sql import functions as F

from roadtrace.operators import graph as g


def _grid(spark, wide=12, seed=3):
    rnd = random.Random(seed)
    place = {(i, j): (i * 100.0 + rnd.uniform(-20, 20), j * 100.0 + rnd.uniform(-20, 20)) for i in range(wide) for j in range(wide)}
    rows = []
    for i, j in place:
        for other in ((i + 1, j), (i, j + 1)):
            for a, b in (((i, j), other), (other, (i, j))):
                if other in place and rnd.random() < 0.85:
                    x, y = place[a]
                    rows.append((len(rows), len(rows) // 3, a[0] * 100 + a[1], b[0] * 100 + b[1], x, y, ((x - place[b][0]) ** 2 + (y - place[b][1]) ** 2) ** 0.5 + rnd.choice([0, 7])))
    return spark.createDataFrame(rows, "id long, way long, `from` long, `to` long, x double, y double, cost double")


def test_reach_near_equals_reach(spark):
    edges = _grid(spark)
    turns = g.successors(edges, spark.createDataFrame([], "via long, from_way long, to_way long, only boolean"))
    links = turns.join(edges.select(F.col("id").alias("edge"), "cost"), "edge")
    want = sorted(map(tuple, g.reach(links, edges.select(F.col("id").alias("start")), "cost", 350, 4).collect()))
    for size, together in ((150.0, 8192), (400.0, 7), (1e6, 100)):
        got = g.reach_near(edges, turns, 350, 4, size, together)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 3000


def test_turns_are_no_rows_of_a_shuffle(spark):
    edges = _grid(spark)
    some = [(a["to"], a["way"], b["way"], a["id"] % 2 == 0) for a in edges.collect() for b in edges.collect() if a["to"] == b["from"] and (a["id"] + b["id"]) % 5 == 0]
    turns = g.successors(edges, spark.createDataFrame(some, "via long, from_way long, to_way long, only boolean"))
    plan = turns._jdf.queryExecution().optimizedPlan().toString()
    # The join of roads at a crossing is the outermost: restrictions were joined to roads before.
    assert plan.index("Join Inner") < plan.index("Join LeftOuter") and "LeftAnti" not in plan and turns.count() > 100


def test_routes_with_dead_ends_ties_and_free_roads(spark):
    from roadtrace.operators import routing

    # 1 to 9 by 2 or 3 alike; 5 and 6 lead to each other for nothing; 50 and on lead nowhere.
    links = [(1, 2), (1, 3), (2, 5), (3, 5), (5, 6), (6, 5), (6, 9), *((1, n) for n in range(50, 90)), *((5, n) for n in range(90, 99))]
    edges = spark.createDataFrame([(n, 0.0 if n in (5, 6) else 1.0) for n in range(1, 100)], "id long, cost double")
    asked = spark.createDataFrame([("a", 1, 9), ("b", 5, 5), ("c", 1, 60), ("d", 9, 1)], "request string, start long, goal long")
    found = routing.shortest(edges, spark.createDataFrame(links, "edge long, next long"), asked, most=14)
    assert sorted(map(tuple, found.collect())) == [("a", 2.0, [1, 2, 5, 6, 9]), ("b", 0.0, [5]), ("c", 1.0, [1, 60])]


def test_totals_of_nearby_roads(spark):
    from roadtrace.operators import spatial as sp

    rnd = random.Random(8)
    roads = []
    for n in range(400):
        x, y, long = rnd.randint(-300, 300), rnd.randint(-300, 300), rnd.choice([5, 5, 40, 300])
        roads.append((n * 10**9, n // 2, n, n + 1, [{"x": float(x), "y": float(y)}, {"x": float(x + rnd.randint(-long, long)), "y": float(y + rnd.randint(-long, long))}]))
    edges = spark.createDataFrame(roads, "id long, way long, `from` long, `to` long, points array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(k, float(rnd.randint(-350, 350)), float(rnd.randint(-350, 350))) for k in range(60) for _ in range(k % 3 + 1)], "k long, x double, y double")
    want = sorted(map(tuple, sp.nearby(points, edges, "k", 10.0, 50.0).groupBy("k").agg(F.count("*"), F.sum("id")).collect()))
    for size, together in ((64.0, 100_000), (1000.0, 30)):
        assert sorted(map(tuple, sp.nearby_totals(points, edges, "k", 10.0, size, together).collect())) == want and len(want) > 40


def test_a_point_meets_its_roads_in_one_cell(spark):
    from roadtrace.operators import spatial as sp

    rnd = random.Random(9)
    roads = [(n, [(rnd.uniform(-400, 400), rnd.uniform(-400, 400)) for _ in range(3)]) for n in range(40)]
    points = [(p, float(rnd.randint(-4, 4)) * 100, rnd.uniform(-400, 400)) for p in range(150)]
    edges = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in line]) for n, line in roads], "id long, points array<struct<x:double,y:double>>")
    asked = spark.createDataFrame(points, "p long, x double, y double")

    def far(x, y, line):
        out = []
        for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
            u = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            out.append(((ax + (bx - ax) * u - x) ** 2 + (ay + (by - ay) * u - y) ** 2) ** 0.5)
        return min(out)

    want = {}
    for p, x, y in points:
        near = sorted((far(x, y, line), n) for n, line in roads if far(x, y, line) < 70)
        if near:
            want[p] = (len(near), near[0][1], round(near[0][0], 6))
    found = sp.nearest_road(asked, edges, "p", 70, 200)
    assert {r["p"]: (r["met"], r["edge"], round(r["error"], 6)) for r in found.collect()} == want and len(want) > 50
    # Once dealt to its cell, a point isn't dealt again: two exchanges, of points and of segments.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = sp.nearest_road(asked, edges, "p", 70, 200)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_bundle_of_a_grid_far_to_the_north(spark, tmp_path):
    from roadtrace.plans import roads

    rows = [(k, k % 50) for first in (0, 9_000_000) for k in range(first, first + 480)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = roads.graph_check(spark, str(tmp_path)).first()
    assert found["roads"] == found["ids"] == roads.road_edges(spark, str(tmp_path)).count() > 900


def test_a_request_with_many_states_is_one_of_a_task(spark):
    from roadtrace.operators import wayfinding as wf

    network = spark.createDataFrame([(7, n) for n in range(5)], "cell long, edge long")
    asked = spark.createDataFrame([(7, r, 0, n, None) for r in range(3) for n in range(200)], "cell long, request long, mode int, edge long, factor double")
    dealt, roads = wf._dealt(asked, network)
    # 600 rows of three requests are one task's, and its roads are sent once.
    assert dealt.select("task").distinct().count() == 1 and roads.count() == 5
    assert "part" not in wf._STATE
