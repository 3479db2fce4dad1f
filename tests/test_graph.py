"""Components by star rounds against union-find."""

import random

from wardline.operators.graph import components


def test_chains_hubs_and_loose_nodes(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2001 + i) for i in range(200)] + [(7, 7), (5000, 5000)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(root) and {r.node: r.root for r in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
