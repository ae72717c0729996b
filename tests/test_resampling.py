"""Draws with replacement of as many clusters as there are, and fair shares, against plain loops."""

from __future__ import annotations

import hashlib
import random

from gleanline.operators import batches, resampling


def number(x):
    return int(hashlib.md5(str(x).encode()).hexdigest()[:8], 16)


def test_each_draw_takes_as_many_as_there_are(spark):
    keys = [f"k{i}" for i in range(300)]
    rows = resampling.resampled(spark.createDataFrame([(k,) for k in keys], "key string"), "key", 20).collect()
    place = sorted(keys, key=lambda k: (number(k), k))
    for draw in range(20):
        want = {}
        for slot in range(300):
            k = place[number(f"{draw}:{slot}") % 300]
            want[k] = want.get(k, 0) + 1
        assert {r.key: r.times for r in rows if r.draw == draw} == want and sum(want.values()) == 300
    assert {(r.key, r.times) for r in rows if r.draw == -1} == {(k, 1) for k in keys}


def test_no_clusters_and_one(spark):
    assert resampling.resampled(spark.createDataFrame([], "key string"), "key", 5).collect() == []
    one = resampling.resampled(spark.createDataFrame([("a", 2.0)], "key string, v double"), "key", 5)
    assert tuple(resampling.interval(one, "v").first()) == (2.0, 2.0, 2.0, 1.0)


def test_shares_against_a_plain_loop(spark):
    rng, rows, want = random.Random(1), [], set()
    for chunk in range(60):
        needs, room = [rng.choice([0, 50, 299, 300, 400, 900, 5000]) for _ in range(rng.randrange(1, 9))], 1900
        rows += [(chunk, f"f{i}", i + 1, n) for i, n in enumerate(needs)]
        needs = needs[: min(batches.MAX_CONTEXT, room // batches.MIN_CONTEXT)]
        left = room
        for i, n in enumerate(needs):
            if left >= batches.MIN_CONTEXT:
                share = min(n, max(batches.MIN_CONTEXT, left // (len(needs) - i)), left)
                want.add((chunk, f"f{i}", i + 1, n, share))
                left -= share
    frame = spark.createDataFrame(rows, "chunk long, file string, place int, tokens long")
    assert {tuple(r) for r in batches.share_context(frame, 1900).collect()} == want
