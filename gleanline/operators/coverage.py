"""What a run has covered: files by outcome, skills by use, runs in one line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage_map(units: DataFrame, skipped: DataFrame, parts: DataFrame) -> DataFrame:
    """(file, changed, status, reason, opened) of each file that is not deleted.

    units: file, deleted, in_chunks, changed; parts: file, kind (done, interrupted or failed), opened;
    skipped: file, reason. A file whose parts all failed has failed, one with some failed is partial.
    """
    kinds = ("done", "interrupted", "failed")
    tally = parts.groupBy("file").agg(*(F.count_if(F.col("kind") == k).alias(f"_{k}") for k in kinds), F.bool_or("opened").alias("opened"))
    rows = units.filter("NOT deleted").join(tally, "file", "left")
    status = F.when(F.coalesce(F.col("_done") + F.col("_interrupted"), F.lit(0)) == 0, "failed").when(F.col("_failed") > 0, "partial").when(F.col("_interrupted") > 0, "interrupted").otherwise("reviewed")
    reason = F.when(F.col("_done").isNull(), F.when(F.col("in_chunks"), "not run").otherwise("not in any chunk"))
    seen = rows.select("file", "changed", status.alias("status"), reason.alias("reason"), F.coalesce("opened", F.lit(False)).alias("opened"))
    away = skipped.select("file", F.lit(0).cast(units.schema["changed"].dataType).alias("changed"), F.lit("skipped").alias("status"), "reason", F.lit(False).alias("opened"))
    return seen.unionByName(away)


def skill_usage(used: DataFrame, dropped: DataFrame, cited: DataFrame, known: DataFrame) -> DataFrame:
    """(skill, chunks, findings, dropped) of every known, used or dropped skill; one chunk counts a skill once."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    facts = used.select("chunk", "skill").distinct().select("skill", one.alias("c"), none.alias("f"), none.alias("d"), F.lit(True).alias("k"))
    facts = facts.unionByName(dropped.select("chunk", "skill").distinct().select("skill", none.alias("c"), none.alias("f"), one.alias("d"), F.lit(True).alias("k")))
    facts = facts.unionByName(cited.select("skill", none.alias("c"), one.alias("f"), none.alias("d"), F.lit(False).alias("k")))
    facts = facts.unionByName(known.select("skill", none.alias("c"), none.alias("f"), none.alias("d"), F.lit(True).alias("k")))
    out = facts.groupBy("skill").agg(F.sum("c").alias("chunks"), F.sum("f").alias("findings"), F.sum("d").alias("dropped"), F.bool_or("k").alias("k"))
    return out.filter("k").drop("k")


def summarize(findings: DataFrame, run: str, provider: str) -> DataFrame:
    """(run, findings, by_severity, providers): a run's counts by severity and the sorted providers it used."""
    counts = findings.groupBy(run, "severity").agg(F.count(F.lit(1)).alias("n"), F.collect_set(provider).alias("p"))
    pairs = F.array_sort(F.collect_list(F.concat("severity", F.lit("="), F.col("n").cast("string"))))
    return counts.groupBy(run).agg(F.sum("n").alias("findings"), F.array_join(pairs, ",").alias("by_severity"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))), ", ").alias("providers"))
