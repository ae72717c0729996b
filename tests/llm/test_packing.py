"""Packing against the tokenizer's own ids and the rules for sequences."""

from __future__ import annotations

import random

import pytest
from tokenizers import Tokenizer

import plain
from gleanline.llm import op5_packing as op


def corpus():
    rng = random.Random(8)
    pool = ["the", "House", "Éclair,", "naïve", "漢字かな", "x_1", "🙂", "don't", "(a)", "A.B.", " ", "ß", "é", "100%"]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "word " * 3000), (4, "ab" * 3000)]
    return rows + [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 300)))) for i in range(5, 120)] + [(7_000, "the House")] * 2


@pytest.mark.parametrize("rows_per_block", [20_000, 7])
def test_pieces_and_sequences(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(op, "CACHE_WORDS", 20)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "s") for r in rows[:-1]], "doc_id long, text string, sequence_id string")
    from gleanline.llm.common import cut

    got = op.pack(cut(op.pieces(docs, op.vocabulary())), rows_per_block=rows_per_block).collect()
    tokenizer = Tokenizer.from_file(op.vocabulary())
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in rows}
    fill = plain.check_packing([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in got], ids)
    assert fill > 0.85


def test_cuts_are_whole_and_few():
    for n in range(1, 6000):
        parts = op.cuts(n)
        assert sum(parts) == n and min(parts) > 0 and max(parts) <= 2048 and len(parts) <= n // 2048 + 6


def test_repeated_rows_and_empty_table(spark):
    from gleanline.llm.common import cut

    docs = spark.createDataFrame([(1, "a b")] * 3, "doc_id long, text string")
    assert op.pack(cut(op.pieces(docs, op.vocabulary()))).count() >= 3
    assert op.pack(cut(op.pieces(docs.limit(0), op.vocabulary()))).collect() == []
