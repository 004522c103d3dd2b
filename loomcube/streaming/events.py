"""Continuous counterparts of the batch steps: deduplicated arrivals and windowed counts of an event stream.

The batch engine knows baseline and update files in which the last version of a document wins; the stream form of
that is deduplication within a watermark, and counts by window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Rows whose key has not come within the watermark; state is dropped with it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total`` by tumbling window; final once the watermark has passed."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, window), "event_type")
    out = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """``user, start, end, n`` of sessions without a gap."""
    grouped = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), user)
    return grouped.agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert(batch: DataFrame, known: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of each key of a micro-batch and the table so far, for ``foreachBatch``."""
    every = known.unionByName(batch)
    latest = every.groupBy(key).agg(F.max(F.struct(version, *[c for c in every.columns if c not in {key, version}])).alias("v"))
    return latest.select(key, "v.*").select(*known.columns)
