"""Components of long chains whose vertices come in random order."""

from __future__ import annotations

import random

from gleanline.operators import graph


def test_shuffled_chains(spark):
    ids = list(range(1, 4002))
    random.Random(5).shuffle(ids)
    chains = [ids[:3000], ids[3000:3999], ids[3999:]]
    edges = [(a, b) for c in chains for a, b in zip(c, c[1:])]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, min(c)) for c in chains for v in c}
