"""Loci and mates over unbounded input. The batch operators see everything at once; here a watermark says what may still come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, time: str, group: str, gap: str, late: str, value: str) -> DataFrame:
    """Bundles of a stream: events of a group that follow each other by less than gap, closed once the watermark is past them."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias(value))
    return found.select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", value)


def tumbling(events: DataFrame, time: str, group: str, width: str, late: str, value: str) -> DataFrame:
    """Sums in windows of fixed width."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias(value)).select(group, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", value)


def mates(reads: DataFrame, time: str, read: str, first: Column, within: str, late: str) -> DataFrame:
    """Pairs of a stream's reads: a first read and its mate come within the given time; later ones are dropped, as unpaired mates are."""
    a = reads.where(first).withWatermark(time, late).select(F.col(read).alias("read"), F.col(time).alias("at"), F.struct(*reads.columns).alias("first"))
    b = reads.where(~first).withWatermark(time, late).select(F.col(read).alias("read_m"), F.col(time).alias("at_m"), F.struct(*reads.columns).alias("mate"))
    near = (F.col("read") == F.col("read_m")) & (F.col("at_m") >= F.col("at") - F.expr(f"INTERVAL {within}")) & (F.col("at_m") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("read", "first", "mate")
