"""Metrics of attempts whose token events arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_summaries(events: DataFrame, gap: str) -> DataFrame:
    """First, last, count and rate per (attempt, session); batch or streaming input.

    events: attempt, ts, at_us.
    """
    session = F.session_window("ts", gap)
    span = F.col("last_time") - F.col("first_time")
    return (
        events.groupBy("attempt", session.alias("session"))
        .agg(
            F.min("at_us").alias("first_time"),
            F.max("at_us").alias("last_time"),
            F.count("*").alias("events"),
        )
        .select(
            "attempt",
            F.col("session.start").alias("session_start"),
            "first_time",
            "last_time",
            "events",
            F.when(
                (F.col("events") >= 2) & (span > 0), (F.col("events") - 1) * 1e6 / span
            ).alias("event_rate"),
        )
    )


def live_attempt_metrics(stream: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Streaming form: a session is emitted once the watermark has passed its end.

    Rows later than `lateness` are dropped by the watermark; Spark counts them
    in the query progress (numRowsDroppedByWatermark).
    """
    return session_summaries(stream.withWatermark("ts", lateness), gap)
