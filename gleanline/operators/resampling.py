"""Bootstrap over clusters: each draw takes as many clusters as there are, with replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _number(of: Column) -> Column:
    """The first 32 bits of a string's MD5."""
    return F.conv(F.substring(F.md5(of.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def positions(rows: DataFrame, key: str) -> DataFrame:
    """rows (one a key) with `pos`: 0, 1, 2 ... by the key's hash, then the key.

    Keys are numbered within 256 parts by their hash, whose counts give where each part begins: no task holds them all.
    """
    dealt = rows.withColumn("_h", _number(F.col(key))).withColumn("_part", F.expr("_h DIV 16777216"))
    inside = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))  # 256 rows
    return inside.join(F.broadcast(starts), "_part").withColumn("pos", F.col("_start") + F.col("_rank") - 1).drop("_h", "_part", "_rank", "_start")


def resampled(clusters: DataFrame, key: str, draws: int) -> DataFrame:
    """clusters (one row a key) with `draw` and `times`: how often each draw takes them; draw -1 is the sample itself.

    A draw's slots are hashed to positions and counted before they meet the clusters, so what is joined
    is one row a cluster and draw at most.
    """
    from gleanline.operators.graph import cut

    placed = cut(positions(clusters, key))
    n = placed.count()
    slots = clusters.sparkSession.range(draws * n).select(F.expr(f"id DIV {max(n, 1)}").alias("draw"), (_number(F.concat_ws(":", F.expr(f"id DIV {max(n, 1)}"), F.expr(f"id % {max(n, 1)}"))) % max(n, 1)).alias("pos"))
    taken = slots.groupBy("draw", "pos").agg(F.count(F.lit(1)).alias("times"))
    own = placed.select("*", F.lit(-1).cast("long").alias("draw"), F.lit(1).cast("long").alias("times"))
    return placed.join(taken, "pos").unionByName(own).drop("pos")


def interval(draws: DataFrame, value: str, share: float = 0.025) -> DataFrame:
    """(observed, low, high, p_positive): the sample's own value (draw -1), the draws' values at the share from either end of their order, and how many of them are positive."""
    drawn = F.col("draw") >= 0
    found = draws.agg(F.array_sort(F.collect_list(F.when(drawn, F.col(value)))).alias("v"), F.max(F.when(~drawn, F.col(value))).alias("observed"))  # a value a draw
    at = lambda q: F.get("v", F.least(F.floor(F.size("v") * q), F.size("v") - 1).cast("int"))
    return found.select("observed", at(share).alias("low"), at(1 - share).alias("high"), F.try_divide(F.size(F.filter("v", lambda x: x > 0)).cast("double"), F.size("v").cast("double")).alias("p_positive"))
