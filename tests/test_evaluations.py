"""Queries that score reviews."""

from __future__ import annotations

from gleanline.plans import evaluations


def test_cases_are_scored_once(spark, monkeypatch):
    rows = spark.createDataFrame([(k, k == 3, 2 * k, k, k, 1, 0, 0, 0, 0, 0, 0, 0) for k in range(8)], ["case", "clean", *evaluations.evaluation.COUNTS])
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(evaluations, "scores", lambda *_: rows.mapInArrow(counted, rows.schema))
    got = {r.suite: (r.expected, r.found, r.recall) for r in evaluations.suite_metrics(spark, "").collect()}
    assert got == {0: (8, 4, 0.5), 1: (12, 6, 0.5), 2: (16, 8, 0.5), 3: (20, 10, 0.5), None: (56, 28, 0.5)}
    assert seen.value == 8


def test_a_case_is_scored_in_one_pass_over_its_pairs(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    evaluation, rng, joins = evaluations.evaluation, random.Random(3), []
    words = ["null check missing", "race in cache", "check for null missing", "other thing here", None]
    rows = [(c, f"{c}:{k}", "a", s := rng.randrange(1, 30), s + rng.randrange(3), rng.choice(words), rng.choice([0.2, 0.9, None]), rng.choice(["critical", "minor", "info", None]), rng.random() < 0.3) for c in range(40) for k in range(rng.randrange(5))]
    truth = [(c, d, rng.choice(["major", "minor"]), rng.choice(words), rng.random() < 0.3, [("./a", s := rng.randrange(1, 30), s + 2), ("a", s + 9, s + 9)]) for c in range(0, 44, 2) for d in range(rng.randrange(4))]
    found = spark.createDataFrame(rows, "case int, id string, file string, start int, end int, title string, confidence double, severity string, out boolean")
    defects = spark.createDataFrame(truth, "case int, defect int, severity string, note string, optional boolean, spots array<struct<file:string,start:int,end:int>>")
    kept, removed = found.filter("NOT out").drop("out"), found.filter("out").drop("out")
    # by steps, as the counts are defined
    roles = [r.asDict() for r in evaluation.match(kept, defects).collect()]
    matched = {(r["case"], r["defect"]): r["id"] for r in roles if r["role"] == "matched"}
    about = {(c, d): (sev, opt) for c, d, sev, _, opt, _ in truth}
    rank = {"critical": 0, "major": 1, "minor": 2, "info": 3}
    missed = defects.filter("NOT optional").filter(~F.concat_ws(":", "case", "defect").isin([f"{c}:{d}" for c, d in matched]))
    lost = [r["case"] for r in evaluation.match(removed, missed).filter("role = 'matched'").collect()]
    near = {(r["case"], r["id"]) for r in evaluation.fits(removed, defects).collect()}
    severity = {r[1]: r[7] for r in rows}
    plain = {}
    for c in {r[0] for r in rows}:
        of = lambda role: sum(r["role"] == role and r["case"] == c for r in roles)  # noqa: B023, E731
        mine = [(about[k], i) for k, i in matched.items() if k[0] == c]
        clean = not any(k[0] == c and not opt for k, (_, opt) in about.items())
        expected, hits = sum(k[0] == c and not opt for k, (_, opt) in about.items()), sum(not opt for (_, opt), _ in mine)
        worse = sum(not opt and severity[i] is not None and rank[severity[i]] > rank[sev] for (sev, opt), i in mine)
        left, saved = of("unmatched"), sum(r[8] and r[0] == c and (c, r[1]) not in near for r in rows)
        plain[c] = (clean, expected, hits, expected - hits, 0 if clean else left, left if clean else 0, of("duplicate"), of("nearby"), sum(opt for (_, opt), _ in mine), worse, lost.count(c), saved)
    overlap = evaluation.overlap_join
    monkeypatch.setattr(evaluation, "overlap_join", lambda *a, **k: joins.append(1) or overlap(*a, **k))
    out = evaluation.score(found, kept, removed, defects)
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == plain
    assert len(joins) == 1
