"""From named checks to a classification, and from packages to a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules


def checks_to_rows(df: DataFrame, keys: Sequence[str], checks: dict[str, tuple[Column, Column]]):
    """(keys, check, status, reasons) from {check: (status, reasons)} columns."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check_name"), status.alias("status"), codes.alias("codes")
            )
            for name, (status, codes) in checks.items()
        ]
    )
    return df.select(*keys, F.explode(rows).alias("_c")).select(*keys, "_c.*")


def classify(
    hard_failed: Column, manual_needed: Column
) -> Column:
    return (
        F.when(hard_failed, "reject").when(manual_needed, "manual-review").otherwise("auto-accept")
    )


def fold_checks(
    rows: DataFrame,
    keys: Sequence[str],
    hard: Sequence[str] = rules.HARD_CHECKS,
    manual: Sequence[str] = rules.MANUAL_CHECKS,
) -> DataFrame:
    """Classification and ordered distinct reasons per package.

    The number of checks per package is fixed by the policy, so the collected
    reason lists are bounded.
    """
    order = list(dict.fromkeys([*hard, *manual]))
    position = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("check_name"))
    relevant = rows.where(F.col("check_name").isin(order))
    folded = relevant.groupBy(*keys).agg(
        F.bool_or(F.col("check_name").isin(list(hard)) & (F.col("status") == "fail")).alias("_hard"),
        F.bool_or(
            F.col("check_name").isin(list(manual)) & (F.col("status") == "manual-review")
        ).alias("_manual"),
        F.array_distinct(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_set(F.struct(position.alias("p"), "codes"))),
                    lambda s: s["codes"],
                )
            )
        ).alias("reason_codes"),
    )
    return folded.select(
        *keys, classify(F.col("_hard"), F.col("_manual")).alias("classification"), "reason_codes"
    )


def inline_decision(
    checks: dict[str, tuple[Column, Column]],
    manual_reasons: Column,
    hard: Sequence[str] = rules.HARD_CHECKS,
    manual: Sequence[str] = rules.MANUAL_CHECKS,
) -> tuple[Column, Column]:
    """The same fold when all checks of a package are columns of one row."""
    failed, review = F.lit(False), F.size(manual_reasons) > 0
    for name in hard:
        failed = failed | (checks[name][0] == "fail")
    for name in manual:
        review = review | (checks[name][0] == "manual-review")
    order = list(dict.fromkeys([*hard, *manual]))
    codes = F.array_distinct(F.concat(*[checks[n][1] for n in order], manual_reasons))
    return classify(failed, review), codes


def triage_batches(
    packages: DataFrame,
    batch: Sequence[str],
    classification: str,
    scope_error: str,
    maximum: int = rules.MAXIMUM_PACKAGES_PER_BATCH,
) -> DataFrame:
    """Batch class: scope errors or too many packages reject it whole, then the worst package."""
    n = F.count("*")
    return (
        packages.groupBy(*batch)
        .agg(
            n.alias("packages"),
            F.bool_or(scope_error).alias("_scope"),
            F.bool_or(F.col(classification) == "reject").alias("_reject"),
            F.bool_or(F.col(classification) == "manual-review").alias("_manual"),
        )
        .select(
            *batch,
            "packages",
            F.when(F.col("_scope") | (F.col("packages") > maximum), "rejected")
            .when(F.col("_reject"), "rejected")
            .when(F.col("_manual"), "manual_review")
            .otherwise("auto_accept")
            .alias("classification"),
            (F.col("_scope") | (F.col("packages") > maximum)).alias("scope_invalid"),
        )
    )


def reason_union(
    df: DataFrame, keys: Sequence[str], codes: str, base: str | None = None
) -> DataFrame:
    """Sorted set of reason codes per key; the codes form a fixed, small vocabulary."""
    one = df.select(*keys, F.explode_outer(codes).alias("_code"))
    found = one.groupBy(*keys).agg(F.collect_set("_code").alias("_codes"))
    all_codes = F.array_union(F.array(F.lit(base)), F.col("_codes")) if base else F.col("_codes")
    return found.select(*keys, F.array_sort(all_codes).alias("reason_codes"))


def unregistered_reasons(df: DataFrame, codes: str, registry: DataFrame) -> DataFrame:
    """Reason codes in use that the registry (column `code`) does not know."""
    used = df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("uses"))
    return used.join(registry, "code", "left_anti")


def final_eligibility(
    structural: Column,
    structural_reasons: Column,
    protocol: Column,
    protocol_reasons: Column,
    primary: Column,
    behaviour_applies: Column,
    behaviour_verified: Column,
) -> tuple[Column, Column, Column, Column]:
    """Performance, its reasons, recommendation, its reasons."""
    none = F.array().cast("array<string>")
    primary_ok = F.coalesce(primary, F.lit(False))
    performance = structural & protocol & primary_ok
    why = F.array_distinct(
        F.concat(
            F.when(~structural, structural_reasons).otherwise(none),
            F.when(~protocol, protocol_reasons).otherwise(none),
            F.when(~primary_ok, F.array(F.lit("primary_metric_ineligible"))).otherwise(none),
        )
    )
    behaviour_ok = ~behaviour_applies | behaviour_verified
    also = F.when(~behaviour_ok, F.array(F.lit("behavior_verification_required"))).otherwise(none)
    return performance, why, performance & behaviour_ok, F.array_distinct(F.concat(why, also))
