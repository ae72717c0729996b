"""Sinks: SARIF and Code Quality reports, the run store, and the cache of results by key.

A report is one JSON text per run, made by Spark from the run's findings; runs are written side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.functions.text import severity_rank

_LEVEL = {"critical": "error", "major": "error", "minor": "warning", "info": "note"}
_QUALITY = {"critical": "critical", "major": "major", "minor": "minor", "info": "info"}
_SCORE = {"critical": "9.5", "major": "8.0", "minor": "5.0", "info": "2.0"}


def _map(column: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(column == k, F.lit(v)) for k, v in table.items()))


def rule_id(analyzer: Column, rule: Column, category: Column, severity: Column) -> Column:
    """The rule that a finding is reported under: its analyzer's, else its category's, security by severity."""
    segment = lambda c: F.substring(F.regexp_replace(c, r"[^\w.@/-]+", "-"), 1, 100)
    own = F.when(category == "security", F.concat(F.lit("review/security/"), severity)).otherwise(F.concat(F.lit("review/"), category))
    return F.when(analyzer.isNotNull(), F.concat_ws("/", segment(analyzer), segment(rule))).otherwise(own)


def sarif(findings: DataFrame, run: str) -> DataFrame:
    """(run, text): a SARIF 2.1.0 log of each run's findings (id columns: file, start, end, severity, category, confidence, title, analyzer, rule_id, fingerprint).

    A rule's level and security score are those of its worst finding.
    """
    named = findings.withColumn("_rule", rule_id(F.col("analyzer"), F.col("rule_id"), F.col("category"), F.col("severity")))
    rank = severity_rank(F.col("severity"))
    level = _map(F.col("severity"), _LEVEL)
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(F.col("start").alias("startLine"), F.greatest("start", "end").alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("_rule").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("finding/v1")).alias("partialFingerprints"), F.struct("severity", "confidence", "category").alias("properties"))
    order = F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), "file", "start", "fingerprint", result.alias("result"))
    results = named.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["result"]).alias("results"))
    worst = named.groupBy(run, "_rule").agg(F.min(F.struct(rank.alias("r"), "severity", "category")).alias("w"))
    properties = F.struct(F.array("w.category").alias("tags"), F.when(F.col("w.category") == "security", _map(F.col("w.severity"), _SCORE)).alias("security-severity"))
    rule = F.struct(F.col("_rule").alias("id"), F.struct(_map(F.col("w.severity"), _LEVEL).alias("level")).alias("defaultConfiguration"), properties.alias("properties"))
    rules = worst.groupBy(run).agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    driver = F.struct(F.struct(F.lit("review").alias("name"), F.col("rules")).alias("driver"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.col("results"))).alias("runs"))
    # the few rules of a run are looked up, so that whole logs are not sorted to meet them
    return results.join(rules.hint("shuffle_hash"), run).select(run, F.to_json(log).alias("text"))


def code_quality(findings: DataFrame, run: str) -> DataFrame:
    """(run, text): each run's findings as an array of Code Quality issues."""
    title = F.trim(F.regexp_replace(F.regexp_replace("title", r"[\x00-\x08\x0B-\x1F\x7F]", ""), r"\s+", " "))
    issue = F.struct(title.alias("description"), rule_id(F.col("analyzer"), F.col("rule_id"), F.col("category"), F.col("severity")).alias("check_name"), "fingerprint", _map(F.col("severity"), _QUALITY).alias("severity"), F.struct(F.col("file").alias("path"), F.struct(F.col("start").alias("begin"), F.greatest("start", "end").alias("end")).alias("lines")).alias("location"))
    order = F.struct(severity_rank(F.col("severity")).alias("r"), (-F.col("confidence")).alias("c"), "file", "start", issue.alias("issue"))
    return findings.groupBy(run).agg(F.to_json(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["issue"])).alias("text"))


def write_runs(runs: DataFrame, path: str, by: str) -> None:
    """Appends runs to the store, a folder for each value of `by`; Spark commits them as a whole."""
    runs.write.mode("append").partitionBy(by).json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs first."""
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def resolve_run(runs: DataFrame, part: str) -> DataFrame:
    """The run that an id's beginning or end names: itself, else the only one that fits; none if several do."""
    found = runs.filter((F.col("id") == part) | F.startswith("id", F.lit(part)) | F.endswith("id", F.lit(part)))
    pick = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("id") == part, F.col("id"))).alias("exact"), F.max("id").alias("only"))
    chosen = pick.select(F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("id")).filter("id IS NOT NULL")
    return runs.join(F.broadcast(chosen), "id", "left_semi")  # one row at most


def cached(spark: SparkSession, wanted: DataFrame, path: str, make, key: str = "key") -> DataFrame:
    """The results of all wanted keys: those in the cache are read, the missing ones are made by make(frame) and added to it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    missing = wanted.join(spark.read.parquet(path).select(key), key, "left_anti") if there else wanted
    make(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(key).distinct(), key, "left_semi")
