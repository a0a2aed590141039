"""Checks and measures over the raw event series of an attempt (long tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.numbers import BYTES_PER_MIB, ratio
from gaugework.operators.ordered import exact_percentiles, previous_values, running_any


def index_contiguity(df: DataFrame, keys: Sequence[str], index: str, start: int = 0) -> DataFrame:
    """True when the indexes of a key are exactly start..start+n-1, each once."""
    n = F.count("*")
    return df.groupBy(*keys).agg(
        n.alias("entries"),
        (
            (F.min(index) == start)
            & (F.max(index) == start + n - 1)
            & (F.countDistinct(index) == n)
        ).alias("contiguous"),
    )


def time_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], time: str
) -> DataFrame:
    """Non-decreasing and strictly increasing flags of a time series per key."""
    paired = previous_values(df, keys, order, {"_previous": time})
    first = F.col("_previous").isNull()
    return paired.groupBy(*keys).agg(
        F.bool_and(first | (F.col(time) >= F.col("_previous"))).alias("non_decreasing"),
        F.bool_and(first | (F.col(time) > F.col("_previous"))).alias("strictly_increasing"),
    )


def intervals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], time: str, name: str
) -> DataFrame:
    """Consecutive differences of `time`; the first row of a key has none."""
    paired = previous_values(df, keys, order, {"_previous": time})
    return paired.withColumn(name, F.col(time) - F.col("_previous")).drop("_previous")


def interval_percentiles(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], time: str, scale: float
) -> DataFrame:
    """p50 / p95 / p99 of the consecutive differences, divided by `scale`."""
    spaced = intervals(df, keys, order, time, "_gap").where(F.col("_gap").isNotNull())
    spaced = spaced.withColumn("_gap", F.col("_gap") / scale)
    return exact_percentiles(
        spaced,
        keys,
        "_gap",
        {"p50": 0.5, "p95": 0.95, "p99": 0.99},
        {"intervals": (F.count("*"), F.sum)},
    )


def series_summary(
    df: DataFrame, keys: Sequence[str], index: str, time: str, units_per_second: float
) -> DataFrame:
    """First and last time, count and event rate (n-1)/(last-first) per key."""
    summary = df.groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.min_by(time, index).alias("first_time"),
        F.max_by(time, index).alias("last_time"),
    )
    span = F.col("last_time") - F.col("first_time")
    rate = F.when(
        (F.col("events") >= 2) & (span > 0), (F.col("events") - 1) * units_per_second / span
    )
    return summary.withColumn("event_rate", rate)


def first_renderable(
    df: DataFrame, keys: Sequence[str], renderable: Column, decoded_at: str
) -> DataFrame:
    """Earliest decode time of a renderable event; null when none is renderable."""
    return df.groupBy(*keys).agg(
        F.min(F.when(renderable, F.col(decoded_at))).alias("first_renderable"),
        F.count_if(renderable).alias("renderable_events"),
    )


def peak_memory(df: DataFrame, keys: Sequence[str], bytes_: Column, valid: Column) -> DataFrame:
    """Peak in MiB; one invalid sample voids the whole series."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.when(F.bool_and(F.coalesce(valid, F.lit(False))), F.max(bytes_) / BYTES_PER_MIB).alias(
            "peak_mib"
        ),
    )


def last_state(
    df: DataFrame, keys: Sequence[str], index: Sequence[str], transition: Column, start: Column
) -> DataFrame:
    """State after the last transition, or the start state without one."""
    order = F.struct(*index)
    return df.groupBy(*keys).agg(
        F.coalesce(
            F.max_by(transition, F.when(transition.isNotNull(), order)), F.min_by(start, order)
        ).alias("end_state")
    )


def critical_stop(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], critical: str
) -> DataFrame:
    """Mark the first critical row and everything after it."""
    return running_any(df, keys, order, critical, "stopped")


def probe_rules(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int
) -> DataFrame:
    """Probing must end with the first renderable event and stay within the limit.

    Expects boolean columns `inspected`, `partial` and `renderable`.
    """
    after = running_any(df, keys, order, "renderable", "_found", include_current=False)
    return after.groupBy(*keys).agg(
        F.count_if("inspected").alias("probes"),
        F.count_if(F.col("inspected") & F.col("_found")).alias("probes_after_found"),
        F.count_if("partial").alias("partial_probes"),
        (F.count_if("inspected") > limit).alias("over_limit"),
    )


def attempt_sequence(
    df: DataFrame, keys: Sequence[str], index: str, is_warmup: Column, expected: int
) -> DataFrame:
    """Index 0 is the warm-up, the others are measured, `expected` attempts in all."""
    fits = F.when(F.col(index) == 0, is_warmup).otherwise(~is_warmup)
    return df.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.bool_and(fits).alias("roles_valid"),
        (
            (F.count("*") == expected)
            & (F.countDistinct(index) == expected)
            & (F.min(index) == 0)
            & (F.max(index) == expected - 1)
        ).alias("count_valid"),
    )


def trace_against_tokens(
    trace: DataFrame, tokens: DataFrame, keys: Sequence[str], index: str, tolerance: int
) -> DataFrame:
    """Match trace entries with token events at the same position of the same attempt.

    `trace` has trace_token, received, origin; `tokens` has token, elapsed.
    """
    both = trace.join(tokens, [*keys, index], "left")
    reason = (
        F.when(F.col("token").isNull(), "no-matching-token")
        .when(~F.col("trace_token").eqNullSafe(F.col("token")), "token-identity-mismatch")
        .when(
            F.abs(F.col("received") - (F.col("origin") + F.col("elapsed"))) > tolerance,
            "clock-relation-invalid",
        )
    )
    return both.withColumn("reason", reason)


def prefill_rate(tokens: Column, duration_ns: Column) -> Column:
    return F.when((tokens > 0) & (duration_ns > 0), ratio(tokens * 1e9, duration_ns))
