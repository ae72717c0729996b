"""run() of the corpus pipeline: behind the trained first stage each stage against its plain version."""

from __future__ import annotations

import random

import plain
from tokenizers import Tokenizer

import corpus_pipeline
from gleanline.llm import op5_packing, op9_toxicity


def corpus():
    rng, pool = random.Random(11), [f"word{k}" for k in range(500)]
    passage = [f"bench{k}" for k in range(30)]
    rows, labels = [(0, None, "en", "a", 0), (1, "", "en", "a", 0)], []
    for i in range(2, 300):
        lines = [" ".join(rng.choice(pool) for _ in range(9)) for _ in range(rng.randrange(1, 9))]
        if i % 7 == 0:
            lines[1:1] = ["licence line one", "licence line two", "licence line three"]
        if i % 11 == 0:
            lines[0] += " " + " ".join(passage[:20])
        toxic = int(rng.random() < 0.25)
        if toxic:
            lines[-1] += " vile grubblik"
        text = "\n".join(lines)
        if i % 13 == 0:
            text = rows[-1][1] + (" end" if i % 2 else "")
        rows.append((i, text, "en", "a" if i % 3 else "b", len(text or "")))
        labels.append((i, 1, toxic))
    return rows, labels, [(1, " ".join(passage)), (2, "tiny")]


def test_run_against_plain_stages(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scores = {r.doc_id: r.score for r in op9_toxicity.query(spark, str(tmp_path)).collect()}
    docs = [(d, t) for d, t, *_ in rows if scores[d] < op9_toxicity.THRESHOLD]
    assert 200 < len(docs) < 290
    docs = [(d, t) for d, (t, cut) in plain.dedup_lines(docs).items() if not cut or plain.TOKEN.search(t)]
    least = plain.components(docs)
    docs = [(d, t) for d, t in docs if least[d] == d]
    report = plain.contamination(docs, items)
    docs = [(d, t) for d, t in docs if not report[d][4]]
    tokenizer = Tokenizer.from_file(op5_packing.vocabulary())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in got]
    plain.check_packing(pieces, {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in docs})


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels, items = corpus()
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
