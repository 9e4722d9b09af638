import random

import pytest

from roadtrace.operators import places as p

rnd = random.Random(8)
BONUS = {"city": 60.0, "town": 30.0}
TOWNS = [(1000 + i, rnd.choice(["city", "town", "hamlet"]), rnd.uniform(-900, 900), rnd.uniform(-900, 900)) for i in range(25)]
#: Around (5000, 5000): the corner of a widened block, just outside it a nearer place, and farther ones that win by their bonus.
TOWNS += [(2000, "hamlet", 5000.0, 5230.0), (2001, "city", 5000.0, 4720.0), (2002, "town", 4790.0, 5160.0)]
#: A dense spot, with two towns at one place.
TOWNS += [(3000 + i, rnd.choice(["city", "town", "hamlet"]), 100 + rnd.uniform(0, 8), 100 + rnd.uniform(0, 8)) for i in range(60)] + [(2999, "town", 104.0, 104.0), (3099, "town", 104.0, 104.0)]
POINTS = [(500 + i, "x", 95 + rnd.uniform(0, 20), 95 + rnd.uniform(0, 20)) for i in range(60)] + [(i, "x", rnd.uniform(-3000, 3000), rnd.uniform(-3000, 3000)) for i in range(150)] + [(200 + i, "x", 5000.0 + rnd.uniform(-700, 700), 5000.0 + rnd.uniform(-700, 700)) for i in range(150)]


@pytest.mark.parametrize(("limit", "few"), [(10_000, 8), (0, 1)])
def test_the_best_of_all_at_every_size(spark, monkeypatch, limit, few):
    """Also where settlements are dense: narrower cells change no answer."""
    monkeypatch.setattr(p, "BROADCAST", limit)
    monkeypatch.setattr(p, "FEW", few)
    want = {}
    for i, _, x, y in POINTS:
        each = [(max(abs(x // 50 - u // 50), abs(y // 50 - v // 50)) > 1, ((x - u) ** 2 + (y - v) ** 2) ** 0.5 - BONUS.get(kind, 0), place) for place, kind, u, v in TOWNS]
        want[i] = min(each)[2]
    schema = "id long, kind string, x double, y double"
    got = p.nearest_settlement(spark.createDataFrame(POINTS, schema), spark.createDataFrame(TOWNS, schema), 50, BONUS)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert {r["id"]: r["place"] for r in got.collect()} == want


def test_no_settlements(spark):
    schema = "id long, kind string, x double, y double"
    assert p.nearest_settlement(spark.createDataFrame(POINTS[:3], schema), spark.createDataFrame([], schema), 50, BONUS).collect() == []
