import random

import numpy as np

from rankspark.llm import components


def graph(seed):
    rnd = random.Random(seed)
    links = [(i, i + 1) for i in range(1000, 1060)]  # a long path
    links += [(500, rnd.randrange(501, 700)) for _ in range(150)]  # a star
    links += [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(180)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    touched = {x for a, b in links if a != b for x in (a, b)}
    return links, {x: find(x) for x in touched}


def test_components(spark):
    links, want = graph(3)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == want
    none = components.connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.collect() == []


def test_solve():
    nodes, labels = components.solve(np.array([5, 9, 7]), np.array([9, 11, 8]))
    assert dict(zip(nodes.tolist(), labels.tolist(), strict=True)) == {5: 5, 9: 5, 11: 5, 7: 7, 8: 7}
