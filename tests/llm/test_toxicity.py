"""The noisy-or model: held-out accuracy, the offending sentence, and odd tables."""

from __future__ import annotations

import random
import zlib

from gleanline.llm import op9_toxicity as op

BAD = ["grubblik", "snarvot", "molquate"]


def corpus(n=900):
    rng, pool, rows, labels = random.Random(1), [f"word{k}" for k in range(300)], [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(pool) for _ in range(8)) for _ in range(rng.randrange(1, 12))]
        if toxic := int(rng.random() < 0.2):
            sentences[rng.randrange(len(sentences))] += " you " + rng.choice(BAD)
        rows.append((i, ". ".join(sentences) + ".", "kept"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_place(spark, tmp_path):
    rows, labels = corpus()
    extra = [(None, None, "n"), (5000, "", "e"), (5001, " .. ", "e"), (5002, "fine " * 20_000 + BAD[0] + ".", "long")]
    spark.createDataFrame(rows + extra, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    truth = {d: t for d, _, t in labels}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].held_out == (d in set(held)) for d in truth)
    assert sum(got[d].predicted == truth[d] for d in held) >= 0.97 * len(held)
    assert got[5000].score == got[5001].score == got[None].score == 0 and got[5002].predicted == 1
    texts = {d: t for d, t, _ in rows}
    for d in held:
        if got[d].predicted:
            assert any(b in texts[d][got[d].worst_start : got[d].worst_end] for b in BAD)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = op.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_no_labels_and_no_rows(spark, tmp_path):
    rows, _ = corpus(20)
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.score for r in op.query(spark, str(tmp_path)).collect()} == {0.0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.score(empty, op.train(empty, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect() == []
