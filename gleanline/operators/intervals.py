"""Interval joins as equi-joins on blocks of positions, so that one hot key spreads over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, start, end) of the runs of adjacent positions."""
    from pyspark.sql import Window

    rows = df.select(*keys, position).distinct()
    island = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(position).alias("start"), F.max(position).alias("end")).drop("_island")


def _blocks(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(end / size)))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], slack: int, block: int, how: str = "inner") -> DataFrame:
    """Rows of a (start, end) and b (start_b, end_b) of equal keys whose ranges overlap within a slack.

    how: inner, left_semi or left_anti. Both sides are dealt by key and block; a pair that shares several
    blocks comes up in the first of them alone.
    """
    left = a.withColumn("_block", _blocks(F.col("start") - slack, F.col("end") + slack, block))
    right = b.withColumn("_block", _blocks(F.col("start_b"), F.col("end_b"), block))
    meets = (F.col("start") <= F.col("end_b") + slack) & (F.col("end") >= F.col("start_b") - slack)
    first = F.col("_block") == F.floor(F.greatest(F.col("start") - slack, F.col("start_b")) / block)
    if how == "inner":
        return left.join(right, [*keys, "_block"]).filter(meets & first).drop("_block")
    # whether a row meets any other follows from its keys and range alone, so only these are dealt, and repeated rows stay
    narrow = a.select(*keys, "start", "end").distinct().withColumn("_block", _blocks(F.col("start") - slack, F.col("end") + slack, block))
    met = narrow.join(right.withColumnsRenamed({k: f"{k}_b" for k in keys}).withColumnRenamed("_block", "_block_b"), [*(F.col(k) == F.col(f"{k}_b") for k in keys), F.col("_block") == F.col("_block_b"), meets], "left_semi").select(*keys, "start", "end").distinct()
    names = [*keys, "start", "end"]
    met = met.withColumnsRenamed({c: f"_m_{c}" for c in names})
    return a.join(met, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in names], how)
