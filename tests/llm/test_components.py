import random

import pytest
from tamarack.llm import components


@pytest.mark.parametrize("few", [0, 20, 20_000])
def test_chains_stars_and_random_links(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(few)
    order = list(range(100))
    rng.shuffle(order)
    links = list(zip(order, order[1:], strict=False)) + [(500, 500 + i) for i in range(1, 30)] + [(900, 900)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = components.label(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == want
    assert components.label(spark.createDataFrame([], "a long, b long")).count() == 0
