"""Passes of an unbounded stream: the batch split with a fixed gap, kept up as events arrive. An addition to the batch operators.

``session_passes`` aggregates with session windows (a watermark bounds the state);
``batch_passes`` gives the same rows from a finished table, and tests hold the two
against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_passes(events: DataFrame, gap_seconds: int, track: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """track, pass_start, last, n: a pass ends when no event follows within the gap."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_t", late) if e.isStreaming else e
    s = F.session_window("_t", f"{gap_seconds} seconds")
    return e.groupBy(track, s).agg(F.min("_t").alias("pass_start"), F.max("_t").alias("last"), F.count(F.lit(1)).alias("n")).drop("session_window")


def batch_passes(events: DataFrame, gap_seconds: int, track: str = "user_id", ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(track).orderBy("_t")
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    gap = F.unix_micros("_t") - F.unix_micros(F.lag("_t").over(w))
    e = e.withColumn("_p", F.sum(F.when(gap >= gap_seconds * 1_000_000, 1).otherwise(0)).over(w))
    return e.groupBy(track, "_p").agg(F.min("_t").alias("pass_start"), F.max("_t").alias("last"), F.count(F.lit(1)).alias("n")).drop("_p")
