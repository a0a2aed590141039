"""Published tables: rows, profiles, claims, matrices, options, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.numbers import reasons

# The claims of a deployment profile and the status each may reach.
CLAIMS = (
    ("physical-device-local-inference", "verified"),
    ("pinned-cached-artifact-load", "verified"),
    ("runtime-token-stream", "verified"),
    ("fresh-attempt-context", "verified"),
    ("model-license-metadata", "verified"),
    ("first-run-download-path", "implementation-supported"),
    ("swift-integration-recipe", "implementation-supported"),
    ("offline-execution", "unknown"),
    ("generation-cancellation", "unknown"),
    ("bundled-model-distribution", "unknown"),
    ("minimum-supported-device", "unknown"),
    ("app-store-readiness", "unknown"),
    ("privacy-compliance", "unknown"),
)
# Parameter size classes by base model.
SIZE_CLASSES = {
    "Qwen/Qwen3-0.6B": "small-0.6b",
    "Qwen/Qwen3-1.7B": "small-1.7b",
    "Qwen/Qwen3-4B": "small-4b",
    "meta-llama/Llama-3.2-1B-Instruct": "small-1b",
    "google/gemma-3-1b-it": "small-1b",
    "ibm-granite/granite-3.3-2b-instruct": "medium-2b",
    "HuggingFaceTB/SmolLM3-3B": "medium-3b",
}


def size_class(base_model: Column) -> Column:
    known = F.lit("unclassified")
    for name, label in SIZE_CLASSES.items():
        known = F.when(base_model == name, label).otherwise(known)
    return known


def constant_in_group(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per key, which fields hold exactly one value (null counts as a value).

    Two mergeable extremes decide it, so no distinct sets are built.
    """
    same = lambda c: F.min(F.col(c)).eqNullSafe(F.max(F.col(c))) & (
        F.count(F.col(c)).isin(0) | (F.count(F.col(c)) == F.count("*"))
    )
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), *[same(c).alias(f"{c}_constant") for c in fields]
    )


def profiles(df: DataFrame, keys: Sequence[str], active: Column, memory: str) -> DataFrame:
    """Counts and the largest median memory over the active rows of each model."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("source_results"),
        F.count_if(active).alias("active_results"),
        F.max(F.when(active, F.col(memory))).alias("maximum_memory"),
    )


def claim_rows(
    profile: DataFrame, keys: Sequence[str], evidence: dict[str, Column], basis: dict[str, Column]
) -> DataFrame:
    """Thirteen claims per profile; a claim without its evidence stays unknown.

    `evidence` maps a claim to the condition it needs, `basis` to the number of
    evidence rows behind it.  A claim that is unknown by contract is never
    promoted.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("claim_id"),
                F.when(F.coalesce(evidence.get(name, F.lit(False)), F.lit(False)), F.lit(status))
                .otherwise("unknown")
                .alias("status"),
                basis.get(name, F.lit(0)).cast("long").alias("basis_rows"),
            )
            for i, (name, status) in enumerate(CLAIMS)
        ]
    )
    return profile.select(*keys, F.explode(rows).alias("_c")).select(
        *keys, "_c.claim_id", "_c.status", "_c.basis_rows"
    )


def publication_state(
    eligible: Column, authorized: Column, declared: Column, metric_reason: Column
) -> tuple[Column, Column]:
    """Active flag and its reasons for a published row."""
    none = F.array().cast("array<string>")
    why = F.array_distinct(
        F.concat(
            F.when(~eligible & metric_reason.isNotNull(), F.array(metric_reason)).otherwise(none),
            F.when(~authorized, F.array(F.lit("final_publication_approval_pending"))).otherwise(
                none
            ),
            F.when(~declared, F.array(F.lit("contributor_declarations_pending"))).otherwise(none),
        )
    )
    return eligible & authorized & declared, why


def limitations(interactive: Column, metric_reason: Column) -> Column:
    base = F.array(
        F.lit("single-device-single-runtime-verification"),
        F.lit("five-measured-attempts-are-not-a-general-thermal-proof"),
    )
    extra = reasons((interactive, "first-renderable-proxy-is-not-screen-render-latency"))
    return F.array_compact(F.array_distinct(F.concat(base, extra, F.array(metric_reason))))


def configuration_matrix(
    df: DataFrame, keys: Sequence[str], workload: str, memory: str, codes: str
) -> DataFrame:
    """Per configuration: workloads, peak memory over them, union of limitations.

    Workloads and limitation codes are fixed vocabularies, so the sets are small.
    """
    return df.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(workload)), ",").alias("workloads"),
        F.max(memory).alias("peak_memory"),
        F.array_join(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(codes))))), ","
        ).alias("limitations"),
    )


def filter_options(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct (field, value) pairs offered by the filters, with row counts."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    )
    return (
        df.select(F.explode(pairs).alias("_p"))
        .groupBy("_p.field", "_p.value")
        .agg(F.count("*").alias("rows"))
    )


def search(df: DataFrame, text: Sequence[str], needle: str, equal: dict[str, str | None]) -> DataFrame:
    """Case-insensitive substring over the joined text columns AND equalities."""
    wanted = needle.strip().lower()
    found = df
    if wanted:
        found = found.where(F.lower(F.concat_ws(" ", *text)).contains(wanted))
    for column, value in equal.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    return found
