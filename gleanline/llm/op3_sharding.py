"""Rendezvous hashing: each record goes to the shard that scores highest for its key.

Every (key, shard) pair has a fixed pseudo-random number u in (0, 1); shard s of weight w scores
-w / ln(u) and the highest score wins. Adding a shard leaves all other scores as they are, so a
record either stays or moves into the new shard; a shard's share follows its weight.

Edge cases: a null key counts as the string 'null' (all such rows share a shard); a null text has
size 8 and checksum 0; repeated rows get the same shard and different slots; an empty table gives
an empty result; any further column of the input is left out of the query's result and kept by
assign().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import cut, documents, numbered

#: md5 digits that make a pair's number: 52 bits, exact as a double.
DIGITS = 13
ROWS_PER_BLOCK = 200_000


def _draw(key: Column, shard: int) -> Column:
    """The pair's number as an integer below 2**52."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}")).cast("binary")), 1, DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key among len(weights) shards. Equal weights need no logarithm: the largest draw wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    if len(weights) == 1:
        return F.lit(0)
    if len(set(weights)) == 1:
        scored = [F.struct(_draw(key, s).alias("score"), F.lit(s).alias("shard")) for s in range(len(weights))]
    else:
        scored = [F.struct((F.lit(-float(w)) / F.log((_draw(key, s) + F.lit(0.5)) / F.lit(2.0**52))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.greatest(*scored)["shard"]


def grown(key: Column, n: int) -> tuple[Column, Column]:
    """The shards of a key among n equal shards and among one more, which need one draw more."""
    best = F.greatest(*(F.struct(_draw(key, s).alias("score"), F.lit(s).alias("shard")) for s in range(n))) if n > 1 else F.struct(_draw(key, 0).alias("score"), F.lit(0).alias("shard"))
    return best["shard"], F.greatest(best, F.struct(_draw(key, n).alias("score"), F.lit(n).alias("shard")))["shard"]


def assign(df: DataFrame, key: str, weights: list[float], name: str = "shard") -> DataFrame:
    """df with the column `name`: the shard of each row."""
    return df.withColumn(name, rendezvous(F.col(key), weights))


def query(spark: SparkSession, sf_dir: str, n_shards: int = 24) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    shard, later = grown(F.col("doc_id"), n_shards)
    # the narrow rows are kept: numbering reads them three times
    placed = cut(rows.withColumns({"shard": shard, "grown_shard": later}))
    out = numbered(placed, ["shard"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], ROWS_PER_BLOCK, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
