"""Components of random links and of a long chain against union-find."""

import collections
import random

from pagegrain.llm.components import components


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for x in list(parent):
        groups[find(x)].append(x)
    expected = {x: min(g) for g in groups.values() for x in g}
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
