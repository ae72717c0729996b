"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.operators.graph import cut, shared_dir  # noqa: F401 (the operators take them from here)

#: The 26 letters that ascii_lower() maps.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; the quicker lower() serves texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(df: DataFrame, group: list[str], order: list[Column], rows_per_block: int, name: str) -> DataFrame:
    """df with the column `name`: 0, 1, 2 ... within each group, gapless, without one task for a whole group.

    Groups are dealt into blocks by a hash of the order key, so that no window holds a whole group;
    the blocks' counts, summed in block order, give where each block's numbers start. The order is
    thus by block first, then by `order` within it: fixed by the rows alone.
    """
    from pyspark.sql import Window

    n_blocks = max(1, -(-df.count() // rows_per_block))
    keyed = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(n_blocks)).cast("int"))
    counts = keyed.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    first = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_start"))
    inner = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order)))
    return inner.join(starts, [*group, "_block"]).withColumn(name, (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_block", "_rank", "_start")
