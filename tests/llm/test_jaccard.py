"""The n-gram Jaccard join against all pairs of a small table."""

from __future__ import annotations

import random

import pytest

from gleanline.llm import op10_jaccard


def brute(rows):
    sets = {}
    for i, text in rows:
        words = [w for w in (text or "").translate(str.maketrans(dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))).split()]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, base = [(0, None), (1, ""), (2, "two Words"), (3, "TWO words"), (4, "  \t\n ")], []
    for _ in range(4):
        base.append([rng.choice(vocabulary) for _ in range(rng.randrange(40, 160))])
    for i in range(5, 260):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows + [(900, rows[20][1]), (901, rows[20][1].upper())]


@pytest.mark.parametrize(("seed", "part_bytes"), [(1, 8_000_000), (8, 2_000)])
def test_against_all_pairs(spark, monkeypatch, seed, part_bytes):
    monkeypatch.setattr(op10_jaccard, "PART_BYTES", part_bytes)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in op10_jaccard.linked(docs).collect()}
    assert got == brute(rows)


def test_bitmaps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64)) for n in (3, 8, 60, 2000)]
    maps = [np.frombuffer(op10_jaccard.bitmap(x), "<u8") for x in lists]
    for x, mx in zip(lists, maps, strict=True):
        for y, my in zip(lists, maps, strict=True):
            assert np.bitwise_count(mx ^ my).sum() <= len(np.setxor1d(x, y))


@pytest.mark.parametrize("seed", [3, 4])
def test_without_hubs(spark, monkeypatch, seed):
    """All links come from the tries alone."""
    monkeypatch.setattr(op10_jaccard, "hub_links", lambda lists: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(op10_jaccard, "STEP", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in op10_jaccard.linked(docs).collect()} == brute(rows)


def test_stage_keeps_one_of_each_group_and_other_columns(spark):
    long = " ".join(f"w{k}" for k in range(30000))
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "a b", "z"), (3, None, "n"), (4, "", "n"), (5, long, "l"), (6, long + " end", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    kept = op10_jaccard.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.cls) for r in kept.collect()} == {(1, "x"), (None, "z"), (3, "n"), (4, "n"), (5, "l")}


def test_empty_table(spark):
    assert op10_jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []
