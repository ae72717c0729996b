"""Running sums over long histories without one task for a whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions that share a block: each block is summed by itself, and the blocks' totals are summed in turn.
BLOCK = 10_000


def running_sum(rows: DataFrame, key: str, position: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with `name`: the sum of value over a key's rows from the highest whole-number position down to this one.

    A key may hold a third of all rows: the windows run over blocks of positions, and over one row a block.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(position) / block))
    totals = blocked.groupBy(key, "_block").agg(F.sum(value).alias("_total"))
    above = Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_block", F.coalesce(F.sum("_total").over(above), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(key, "_block").orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumn("_inside", F.sum(value).over(inside)).join(carried, [key, "_block"])
    return summed.withColumn(name, F.col("_carried") + F.col("_inside")).drop("_block", "_inside", "_carried")
