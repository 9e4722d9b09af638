"""Components over many rounds: right labels, and an estimated size that doesn't explode with the rounds."""

import random

from roadtrace.llm.components import components


def test_estimates_stay_small_over_rounds(spark):
    """A join's estimate is the product of its sides'; over the rounds of a long chain it had a million digits."""
    nodes = list(range(400))
    random.Random(5).shuffle(nodes)
    hub = [(1000, 1000 + k) for k in range(1, 200)]
    links = spark.createDataFrame([*zip(nodes, nodes[1:], strict=False), *hub, (3000, 3000), (5000, 5001), (5001, 5000)], "a long, b long")
    labels = components(links)
    got = sorted(map(tuple, labels.collect()))
    assert got == sorted([(n, 0) for n in nodes] + [(1000, 1000)] + [(b, 1000) for _, b in hub] + [(5000, 5000), (5001, 5000)])
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
