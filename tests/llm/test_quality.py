"""The ledger's measures against plain counts, and policies and ablations against a plain count of failures."""

from __future__ import annotations

import random

import plain
from gleanline.llm import op4_quality as op


def corpus():
    rng, pool = random.Random(6), ["a", "bb", "Über", "漢字", "x#y", "$$", "<b>", "SHOUT", "word"]
    rows = [(0, None), (1, ""), (2, " \t\r\n"), (3, "one two three four five six seven eight nine ten"), (4, "a b c d e " * 2000), (5, "same\nsame\n\nsame\n"), (6, "x" * 60_000)]
    return rows + [(i, rng.choice((" ", "\n")).join(rng.choice(pool) for _ in range(rng.randrange(0, 80)))) for i in range(7, 200)]


def test_measures(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([*rows, rows[9]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 1
    texts = dict(rows)
    for r in got:
        n_words, word_chars, n_symbols, n_dup, n_repeat = plain.measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup, n_repeat), r
        assert r.base_failed == (n_words < 10 or 100 * n_repeat > 20 * n_words)
        assert not (r.base_failed and r.kept)


def test_ablation_counts_what_each_rule_drops(spark):
    ledger = op.ledger(spark.createDataFrame([(t, "s" if i % 2 else "t") for i, t in corpus()], "text string, source string"))
    rows = ledger.collect()
    rules = op.POLICIES["v3"]
    for got in op.ablation(ledger, "v3", ["source"]).collect():
        bits = [r.failed_bits & op.mask(rules) for r in rows if r.source == got.source]
        bit = op.BIT[got.rule]
        assert (got.n_failed, got.n_failed_alone, got.n_kept_without) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(not b & ~bit for b in bits))


def test_columns_named_like_measures(spark):
    docs = spark.createDataFrame([(1, "a b", 99, 5, "kept")], "doc_id long, text string, n_words int, failed_bits int, other string")
    row = op.apply_policy(op.ledger(docs), "v2").first()
    assert row.n_words == 2 and row.other == "kept" and row.kept is False
    assert op.ledger(docs.limit(0)).collect() == []
