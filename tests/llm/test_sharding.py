"""Rendezvous hashing: shares by weight, few moves, gapless slots."""

from __future__ import annotations

import zlib
from collections import Counter

from gleanline.llm import op3_sharding as op


def shards(spark, keys, weights):
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    return {r.k: r.shard for r in op.assign(rows, "k", weights).collect()}


def test_shares_follow_the_weights(spark):
    got = Counter(shards(spark, range(8000), [1.0, 2.0, 5.0]).values())
    assert abs(got[0] - 1000) < 130 and abs(got[1] - 2000) < 170 and abs(got[2] - 5000) < 200


def test_a_new_shard_only_takes(spark):
    for weights in ([1.0] * 6, [1.0, 3.0, 0.5]):
        before, after = shards(spark, range(3000), weights), shards(spark, range(3000), [*weights, 1.0])
        moved = {k for k in before if before[k] != after[k]}
        assert moved and {after[k] for k in moved} == {len(weights)}


def test_query(spark, tmp_path):
    long = "é" * 50_000
    rows = [(k, f"text {k}", "x") for k in range(500)] + [(1, "text 1", "x"), (None, None, None), (7, "", None), (900, long, "y")]
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op.query(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots = {}
    for r in got:
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op.query(spark, str(tmp_path)).collect() == []


def test_against_a_plain_loop_over_shards(spark):
    import hashlib
    import math

    draw = lambda key, s: int(hashlib.md5(f"{'null' if key is None else key}:{s}".encode()).hexdigest()[: op.DIGITS], 16)
    keys = [None, *range(-50, 400)]
    for weights in ([1.0] * 24, [2.0, 1.0, 0.25, 7.0]):
        score = (lambda k, s: draw(k, s)) if len(set(weights)) == 1 else (lambda k, s: -weights[s] / math.log((draw(k, s) + 0.5) / 2.0**52))  # noqa: B023
        assert shards(spark, keys, weights) == {k: max(range(len(weights)), key=lambda s: (score(k, s), s)) for k in keys}
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    best, later = op.grown(op.F.col("k"), 24)
    got = {r.k: (r.a, r.b) for r in rows.select("k", best.alias("a"), later.alias("b")).collect()}
    assert got == {k: tuple(max(range(n), key=lambda s: (draw(k, s), s)) for n in (24, 25)) for k in keys}
