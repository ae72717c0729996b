"""How the plans deal the driver's tables."""

from __future__ import annotations

from gleanline.plans import facts, manifests


def test_findings_are_dealt_before_they_are_made_distinct(spark):
    sf_dir = "/root/testdata/sf0.001"
    lines = facts.table(spark, sf_dir, "lineitem")
    rows = facts.findings(spark, sf_dir)
    steps = [s for s in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in s or "RepartitionByExpression" in s]
    assert ["Aggregate" in s for s in steps] == [True, False]  # from the top: distinct, then the deal below it
    assert facts.tasks(lines) == facts.TASKS_A_SPLIT * lines.rdd.getNumPartitions()
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    parts = facts.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    assert rows.count() == lines.select(*keys).distinct().join(parts, "l_partkey").count()


def test_orders_are_dealt_before_they_are_made_distinct(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(manifests.toml, "file_versions", lambda files: seen.append(files) or files.selectExpr("file", "'t' AS tech", "'1' AS version", "'w' AS what"))
    monkeypatch.setattr(manifests.toml, "toml_versions", lambda files: files.selectExpr("file", "'t' AS tech", "'1' AS version", "'w' AS what"))
    manifests.declared_versions(spark, "/root/testdata/sf0.001")
    steps = [s for s in seen[0]._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in s or "RepartitionByExpression" in s]
    assert ["Aggregate" in s for s in steps] == [True, False]


def test_lock_files_take_one_shuffle(spark):
    plan = manifests.locked_gems(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
