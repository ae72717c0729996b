"""Winnowing against a plain search for windows, on both plans."""

from __future__ import annotations

import random

import pytest

import plain
from gleanline.llm import op1_decontamination as op

ITEMS = [(1, " ".join(f"w{k}" for k in range(40))), (2, "short Item"), (3, None), (4, "..."), (5, "one two three four five six"), (6, "é ü 漢字 a b c d e f g h i j k"), (2, "short Item"), (7, "solo")]


def corpus(seed):
    rng, vocabulary = random.Random(seed), [f"w{k}" for k in range(60)] + ["x", "y"]
    rows = [(0, None), (1, ""), (2, "  ,;"), (3, "SHORT item!"), (4, "one, two: three four five six seven"), (5, "é ü 漢字 a b c d e f g h i j k l"), (6, "solo"), (7, " ".join(f"q{k}" for k in range(30_000)) + " " + ITEMS[0][1])]
    for i in range(8, 120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        at, start = rng.randrange(len(w)), rng.randrange(30)
        w[at:at] = [f"w{k}" for k in range(start, min(40, start + rng.randrange(8, 20)))]
        rows.append((i, rng.choice((" ", ", ", " - ")).join(w)))
    return rows + [(200, rows[20][1]), (200, rows[20][1])]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_against_a_plain_search(spark, broadcast_rows):
    rows = corpus(4)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op.report(docs, items, broadcast_rows).collect()}
    assert got == plain.contamination(rows, ITEMS)


def test_stage_and_empty_tables(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus(5)
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_hit string")
    kept = op.stage(spark, docs, str(tmp_path))
    clean = {d for d, x in plain.contamination(rows, ITEMS).items() if not x[4]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.report(empty, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect() == []
    assert {r.n_hit for r in op.report(docs, spark.createDataFrame([], "item_id long, text string")).collect()} == {0}
