"""Review facts read out of the driver's tables: findings from lineitem, files from orders; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITY = "CASE {} % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'info' END"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END"

#: Tasks that the rows of one split are dealt to.
TASKS_A_SPLIT = 8

_ID = "concat(CAST(l_orderkey AS {s}), ':', CAST(l_linenumber AS {s}), ':', CAST(l_partkey AS {s}), ':', CAST(l_suppkey AS {s}))"
_FINDING = [
    ("id", _ID),
    ("file", "l_orderkey"),
    ("run", "l_orderkey % 500"),
    ("start", "1 + l_partkey % 60"),
    ("end", "1 + l_partkey % 60 + l_linenumber % 4"),
    ("severity", SEVERITY.format("l_suppkey")),
    ("category", "CASE l_partkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'bug' ELSE 'style' END"),
    ("confidence", "CAST((2 + (l_suppkey * 7 + l_partkey) % 98) AS DOUBLE) / CAST(100 AS DOUBLE)"),
    ("non_rejectable", "l_partkey % 11 = 0"),
    ("analyzer", "concat('a', CAST(l_suppkey % 2 AS {s}))"),
    ("rule_id", "concat('r', CAST(l_partkey % 4 AS {s}))"),
    ("title", "concat(p_name, ' ', CAST(l_partkey % 7 AS {s}))"),
    ("part", "l_partkey"),
    ("supp", "l_suppkey"),
]


def _expressions(string: str, quote: str) -> str:
    return ", ".join(f"{e.replace('{s}', string)} AS {quote}{name}{quote}" for name, e in _FINDING)


#: `f`: findings, `o`: files with their line numbers and changed ranges (none for every fifth, no file for every thirteenth).
SQL = f"""f AS (SELECT DISTINCT {_expressions('VARCHAR', '"')} FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT o_orderkey AS file, 20 + o_custkey % 45 AS n_lines, o_orderkey % 7 = 0 AS is_test, 1 + o_orderkey % 30 AS a1, 6 + o_orderkey % 30 AS b1, 21 + o_orderkey % 30 AS a2, 24 + o_orderkey % 30 AS b2, o_orderkey % 5 = 0 AS whole FROM orders WHERE o_orderkey % 13 <> 0)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame) -> int:
    """The number of tasks to deal a table's rows to: it grows with the splits that are read, so that what one task holds does not."""
    return TASKS_A_SPLIT * rows.rdd.getNumPartitions()


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # dealt first: few rows are equal, and a split's own distinct rows would all be held before the shuffle
    rows = rows.repartition(tasks(rows), "l_orderkey").distinct()
    named = rows.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select(*(F.expr(e.replace("{s}", "STRING")).alias(name) for name, e in _FINDING))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 13 <> 0")
    ranges = F.array(F.expr("named_struct('a', 1 + o_orderkey % 30, 'b', 6 + o_orderkey % 30)"), F.expr("named_struct('a', 21 + o_orderkey % 30, 'b', 24 + o_orderkey % 30)"))
    return rows.select(F.col("o_orderkey").alias("file"), F.expr("20 + o_custkey % 45").alias("n_lines"), F.expr("o_orderkey % 7 = 0").alias("is_test"), F.when(F.expr("o_orderkey % 5 <> 0"), ranges).alias("ranges"))
