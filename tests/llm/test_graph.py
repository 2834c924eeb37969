"""Components: the same as by union-find, and no more steps than the links need, as each is a handful of shuffles."""

import random

import pytest

from weir.llm import graph


def least(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for pair in links if pair[0] != pair[1] for x in pair}


pick = random.Random(3)
STAR = [(i, 5) for i in range(6, 40)] + [(2, 50), (50, 2), (7, 7)]
CHAIN = [(i, i + 1) for i in range(40)]
MIXED = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(7, i) for i in range(400, 450)]


@pytest.mark.parametrize(("links", "most"), [(STAR, 1), ([], 1), (CHAIN, 8), (MIXED, 6)], ids=["star", "none", "chain", "mixed"])
def test_components(spark, monkeypatch, links, most):
    written = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: written.append(name) or stored(df, name))
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(got) == least(links) and len(got) == len(least(links))
    assert len(written) <= most
