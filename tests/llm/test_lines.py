"""Line dedup against a plain pass over the documents in order."""

from __future__ import annotations

import random

import plain
from gleanline.llm import op2_lines as op


def corpus():
    rng, pool = random.Random(2), [f"line {k}" for k in range(12)] + ["", "  ", "\t"]
    rows = [(0, None), (1, ""), (2, "a\nb\nc"), (3, "a\nb\nc"), (4, "x\n\na\n \nb\n\nc\ny"), (5, "a\nb\nc\na\nb\nc"), (6, "\n".join(f"l{k}" for k in range(20_000)) + "\na\nb\nc")]
    return rows + [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))) for i in range(7, 150)]


def test_against_a_plain_pass(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in op.dedup(docs).collect()}
    assert got == plain.dedup_lines(rows)


def test_stage_keeps_columns_of_any_name(spark):
    rows = [(1, "a\nb\nc\nd", 7, "k", 8), (2, "a\nb\nc", 8, "k", 5), (3, "a\nb\nc\ne", 9, "m", 8), (None, "p\nq", 3, None, 3), (4, None, 0, "z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, `_cut` string, n_chars long")
    kept = op.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {(1, "a\nb\nc\nd", 7, "k", 8), (3, "e", 9, "m", 1), (None, "p\nq", 3, None, 3), (4, None, 0, "z", 0)}


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd")] * 2 + [(2, "z\na\nb\nc")], "doc_id long, text string")
    assert sorted(r.text for r in op.dedup(docs).collect()) == ["a\nb\nc\nd", "a\nb\nc\nd", "z"]
    assert op.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
