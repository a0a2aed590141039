"""Per-attempt values, per-result aggregates and their eligibility gates.

Attempt tables carry: result_id, idx, phase, outcome, accepted_ns,
first_token_ns, first_renderable_ns, completed_ns, prompt_ns, decode_ns,
input_tokens, output_tokens, peak_bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.numbers import (
    BYTES_PER_MIB,
    NS_PER_MS,
    NS_PER_SECOND,
    close_enough,
    percent_change,
)
from gaugework.operators.ordered import exact_median


def attempt_values(field=F.col) -> dict[str, Column]:
    """Metric expressions of one attempt; `field` resolves a column by name."""
    since = lambda name: (field(name) - field("accepted_ns")) / NS_PER_MS
    rate = lambda tokens, name, least: F.when(
        (field(name) > 0) & least, tokens / (field(name) / NS_PER_SECOND)
    )
    decode = rate(field("output_tokens") - 1, "decode_ns", field("output_tokens") >= 2)
    return {
        "first_renderable_ms": since("first_renderable_ns"),
        "pipeline_ttft_ms": since("first_token_ns"),
        "request_completion_ms": since("completed_ns"),
        "prefill_tokens_per_second": rate(
            field("input_tokens"), "prompt_ns", field("input_tokens") > 0
        ),
        "decode_tokens_per_second": decode,
        "peak_physical_footprint_mib": field("peak_bytes") / BYTES_PER_MIB,
    }


def measured_and_succeeded(attempts: DataFrame) -> DataFrame:
    return attempts.where((F.col("phase") == "measured") & (F.col("outcome") == "succeeded"))


def long_values(attempts: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One row per (attempt, metric)."""
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric_id"), v.cast("double").alias("metric_value"))
            for m, v in values.items()
        ]
    )
    return attempts.select(*keys, F.explode(entries).alias("_m")).select(*keys, "_m.*")


def result_values(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median (or maximum for the peak) per (result, metric), with eligible attempts."""
    maxima = [m for m, aggregation, _, _ in rules.METRICS if aggregation == "maximum"]
    summary = exact_median(
        long,
        [*keys, "metric_id"],
        "metric_value",
        "_median",
        {"eligible_attempts": (F.count("metric_value"), F.sum), "_max": (F.max("metric_value"), F.max)},
        together=keys,
    )
    value = F.when(F.col("metric_id").isin(maxima), F.col("_max")).otherwise(F.col("_median"))
    return summary.select(*keys, "metric_id", value.alias("value"), "eligible_attempts")


def first_to_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, eligible: Column
) -> DataFrame:
    """Change in % from the first to the last eligible attempt; null below two or from 0."""
    usable = F.when(eligible & value.isNotNull(), F.struct(*order))
    ends = df.groupBy(*keys).agg(
        F.min_by(value, usable).alias("_first"),
        F.max_by(value, usable).alias("_last"),
        F.count(usable).alias("_n"),
    )
    change = F.when(F.col("_n") >= 2, percent_change(F.col("_first"), F.col("_last")))
    return ends.select(*keys, change.alias("change_percent"))


def attempt_gate(eligible_attempts: Column, minimum: int = rules.MINIMUM_ELIGIBLE_ATTEMPTS) -> Column:
    """Reason code of a metric without enough eligible attempts, else null."""
    return F.when(eligible_attempts < minimum, "insufficient-successful-measured-attempts")


def metric_status(
    metric_id: Column,
    workload_id: Column,
    contract_valid: Column,
    target_reasons: Column,
    eligible_attempts: Column,
) -> tuple[Column, Column]:
    """Status and reasons of one metric: scope, contract, environment, then the count."""
    interactive_only = [m for m, _, _, s in rules.METRICS if s == "interactive-workload-only"]
    sustained_only = [m for m, _, _, s in rules.METRICS if s == "sustained-workload-only"]
    undefined = (metric_id.isin(interactive_only) & ~workload_id.eqNullSafe(rules.INTERACTIVE)) | (
        metric_id.isin(sustained_only) & ~workload_id.eqNullSafe(rules.SUSTAINED)
    )
    gate = attempt_gate(F.coalesce(eligible_attempts, F.lit(0)))
    why = (
        F.when(undefined, F.array(F.lit("metric-not-defined-for-workload")))
        .when(~contract_valid, F.array(F.lit("contract-conformance-failed")))
        .when(F.size(target_reasons) > 0, target_reasons)
        .otherwise(F.array_compact(F.array(gate)))
    )
    return F.when(F.size(why) == 0, "pass").otherwise("not-applicable"), why


def medians_by_generation(
    df: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """The median under each generation's minimum number of values."""
    summary = exact_median(df, keys, value, "_median", {"values": (F.count(value), F.sum)})
    return summary.select(
        *keys,
        "values",
        *[
            F.when(F.col("values") >= rule.median_minimum, F.col("_median")).alias(
                "median_" + name.replace("-", "_")
            )
            for name, rule in rules.GENERATIONS.items()
        ],
    )


def outcome_counts(df: DataFrame, keys: Sequence[str], outcome: str, outcomes) -> DataFrame:
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(outcome) == o).alias(f"n_{o}") for o in outcomes]
    )


def compare_reported(
    reported: DataFrame, recomputed: DataFrame, keys: Sequence[str], tolerance: float
) -> DataFrame:
    """Join reported with recomputed values and flag those out of tolerance."""
    both = reported.join(recomputed, list(keys), "left")
    return both.withColumn(
        "matches", close_enough(F.col("reported"), F.col("recomputed"), tolerance)
    )


def prefer_recomputed(
    recomputed: Column, exported: Column, applies: Column, enough: Column
) -> Column:
    """Raw-series value where the old text rule nulled it, else the exported value."""
    return F.when(applies & enough, recomputed).otherwise(exported)
