"""Order-dependent operators and graphs on small fixtures, against plain Python."""

from __future__ import annotations

import random

from gleanline.operators import graph, greedy, intervals


def test_fills(spark):
    rows = [("a", k, n) for k, n in enumerate([5, 7, 2, 9, 1, 12])]
    items = spark.createDataFrame(rows, "g string, k long, n long")
    taken = {r.k for r in greedy.skip_fill(items, ["g"], "n", ["k"], 10).collect() if r.taken}
    assert taken == {0, 2, 4}  # 7, 9 and 12 don't fit and are skipped
    chunks = {r.k: r.chunk for r in greedy.reset_fill(items, ["g"], "n", ["k"], 10).collect()}
    assert chunks == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3}


def test_dedupe_is_not_transitive(spark):
    rows = [("f", 1, 1, "bug", "alpha beta gamma", 0.9), ("f", 3, 3, "bug", "alpha beta gamma", 0.8), ("f", 5, 5, "bug", "alpha beta gamma", 0.7), ("f", 1, 1, "style", "other words entirely", 0.6)]
    out = greedy.dedupe(spark.createDataFrame(rows, "file string, start int, end int, category string, title string, confidence double"), ["file"]).collect()
    assert sorted((r.start, r.confidence, r.merged) for r in out) == [(1, 0.6, 1), (1, 0.9, 2), (5, 0.7, 1)]


def test_match_is_one_to_one(spark):
    rows = [("c", 1, 1, 0.5, 0, 1.0, 0.9), ("c", 1, 2, 0.5, 0, 1.0, 0.9), ("c", 2, 1, 0.5, 1, 0.0, 0.9), ("c", 2, 2, 0.0, 0, 1.0, 0.9)]
    out = greedy.match(spark.createDataFrame(rows, "case string, finding long, defect long, similarity double, gap long, iou double, confidence double"), ["case"]).collect()
    assert sorted((r.finding, r.defect) for r in out) == [(1, 1), (2, 2)]


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(3)
    a = [(rng.choice("xy"), s := rng.randrange(300), s + rng.randrange(40), k) for k in range(60)]
    b = [(rng.choice("xy"), s := rng.randrange(300), s + rng.randrange(40), k) for k in range(60)]
    da, db = spark.createDataFrame(a, "key string, start long, end long, i long"), spark.createDataFrame(b, "key string, start_b long, end_b long, j long")
    want = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] + 3 and x[2] >= y[1] - 3}
    got = [(r.i, r.j) for r in intervals.overlap_join(da, db, ["key"], 3, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    near = {i for i, _ in want}
    assert {r.i for r in intervals.overlap_join(da, db, ["key"], 3, 16, "left_semi").collect()} == near
    assert {r.i for r in intervals.overlap_join(da, db, ["key"], 3, 16, "left_anti").collect()} == {x[3] for x in a} - near


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101)]
    out = {r.v: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100}
