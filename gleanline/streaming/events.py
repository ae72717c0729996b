"""Streams of events: windowed counts, sessions, and each fingerprint once, all with bounded state.

A watermark says how late an event may come; the state of older windows, sessions and fingerprints goes.
Every function takes a batch frame as well, and then gives what the stream gives once all has come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, time: str, keys: list[str], length: str, late: str, slide: str | None = None, measures: list[Column] | None = None) -> DataFrame:
    """(start, end, keys, n, measures) by tumbling or sliding windows."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, length, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), *(measures or []))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in counted.columns if c != "w"))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(start, end, keys, n): runs of events with no silence longer than the gap."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def once(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    marked = events.withWatermark(time, late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)
