"""Turns of conversations in order, and running sums along them, without a task that holds a whole conversation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanline.llm.common import scratch

#: Positions of a block: windows hold one block of one group at most.
BLOCK = 1024


def ordered(rows: DataFrame, order: list[Column], then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """rows (with conv_id) written in the order of conv_id and `order`, with _id: unique, rising along it, its upper bits the part.

    A range shuffle deals the rows, so one conversation may lie in many parts; a counter splits equal rows too.
    `then`, which keeps rows and order, works behind the shuffle: what stands before it runs a second time, for the ranges' sample.
    """
    counted = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col("conv_id"), *order, F.col("_tie")]
    path = scratch(rows.sparkSession, "turns")
    then(counted.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def placed(rows: DataFrame) -> DataFrame:
    """rows of ordered() with k: 0, 1, 2 ... within each conversation. Each part's count of a conversation gives where the next part's numbers start."""
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv_id", "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = starts.select(F.col("conv_id").alias("_c"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    met = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("k", F.col("_id") - F.col("_first") + F.col("_before")).drop("_c", "_p", "_part", "_first", "_before")


def running(rows: DataFrame, group: str, at: str, sums: list[str], backwards: bool = False, block: int = BLOCK) -> DataFrame:
    """rows with each column of `sums` replaced by its sum up to and with the row, along `at` within the group (backwards: from the row on).

    Sums run within blocks of positions; the blocks' totals, summed in their order, are added to them.
    """
    rows = rows.withColumn("_block", F.floor(F.col(at) / block))
    towards = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    earlier = Window.partitionBy(group).orderBy(towards("_block")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(group, "_block").orderBy(towards(at)).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(group, "_block").agg(*(F.sum(c).alias(c) for c in sums))
    bases = totals.select(group, "_block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    within = rows.withColumns({c: F.sum(c).over(inside) for c in sums})
    return within.join(bases, [group, "_block"]).withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_block", *(f"_{c}" for c in sums))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
