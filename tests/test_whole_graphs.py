"""The graph queries over the whole table against plain Python: no slice of the lines, no folded ids."""

import math
import random
from collections import defaultdict

import pytest

from roadtrace.plans import catalogue

rnd = random.Random(5)
# Orders of one to four lines; suppliers and parts share ids, some beyond the foldings of the sliced queries.
LINES = [(o, n, rnd.choice([*range(12), 20, 33, 47, 58, 100, 200]), rnd.choice([*range(12), 20, 33, 47, 58, 100, 200]), float(rnd.randint(1, 9))) for o in range(1, 90) for n in range(1, rnd.randint(2, 5))]
# Ways back, and orders that share parts with the next.
LINES += [(o, 6, p, s, q + 1) for o, n, s, p, q in LINES if n == 1 and o % 4 == 0] + [(o + 1, 7, 3, p, q) for o, n, s, p, q in LINES if n == 1 and o % 3 == 0]
ORDERS = [(o, rnd.choice([*range(12), 100, 200]), rnd.choice("FOP")) for o in range(1, 90)]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{root}/orders.parquet")
    return lambda name: sorted(map(tuple, catalogue.queries()[name](spark, root).collect()))


def test_successors_and_reverses(run):
    edges = [(o * 10 + n, o, s, p, q) for o, n, s, p, q in LINES]
    ban, must = set(), defaultdict(set)
    for o, c, status in ORDERS:
        if status == "P":
            must[c, o].add(o * 7 + c)
        else:
            ban.add((c, o, o * 7 + c))
    want, back = defaultdict(lambda: [0, 0]), {}
    for a, way, s, via, q in edges:
        for b, other, start, end, r in edges:
            if start == via and not (way == other and end == s) and (via, way, other) not in ban and must.get((via, way), {other}) == {other}:
                want[a % 1000][0] += 1
                want[a % 1000][1] += b
            if way == other and (s, via) == (end, start) and abs(q - r) < 5:
                back[a] = min(b, back.get(a, b))
    assert run("anti_restrictions_whole") == sorted((k, *v) for k, v in want.items())
    assert run("reverse_edges_whole") == sorted(back.items()) and len(back) > 20


def test_reach_and_routes(run):
    cost, net = {}, defaultdict(set)
    for _, _, s, p, _ in LINES:
        cost[s, p] = 1.0 + (s * 7 + p) % 13
        net[s].add(p)
    want = {}
    for start in set(net):
        best = layer = {start: 0.0}
        for _ in range(4):
            step = {}
            for node, c in layer.items():
                for n in net[node] if node in net else ():
                    if c + cost[node, n] <= 9:
                        step[n] = min(step.get(n, 99), c + cost[node, n])
            layer, best = step, {n: min(step.get(n, 99), best.get(n, 99)) for n in {*step, *best}}
        want |= {(start, n): c for n, c in best.items()}
    assert run("bounded_reach_whole") == sorted((*k, c) for k, c in want.items())
    routes = []
    for start in {s for s in net if s % 100 == 0}:
        best = {start: 0.0}
        for _ in range(40):
            for node in list(best):
                for n in net[node] if node in net else ():
                    best[n] = min(best.get(n, 99), best[node] + 1 + node % 3)
        routes += [(start, g, best[g]) for g in (20, 33, 47) if best.get(g, 99) <= 14]
    assert run("shortest_routes_whole") == sorted(routes)


def test_shared_validity_and_junctions(run):
    by, length, turns = defaultdict(list), {}, {(s, p) for _, _, s, p, _ in LINES}
    for o, n, s, p, q in sorted(LINES):
        by[o].append(s)
        length[o, p] = max(q, length.get((o, p), 0))
    shared = defaultdict(list)
    for (o, p), q in length.items():
        if (o + 1, p) in length:
            shared[o].append(q)
    assert run("shared_route_length_whole") == sorted((o, len(v), sum(v)) for o, v in shared.items())
    valid = {o: len(set(v)) == len(v) and all(t in turns for t in zip(v, v[1:], strict=False)) for o, v in by.items()}
    assert run("route_validity_whole") == sorted(valid.items()) and len(set(valid.values())) == 2
    known = {s for s, _ in turns}
    got = {(a, b): x for a, b, x in run("junction_candidates_whole")}
    angle = {(a, b): math.remainder((b * 53 % 63 - a * 37 % 63) / 10, 2 * math.pi) for a, b in turns if b in known}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in angle.items() if 0.77 <= abs(v) <= 2.11}
