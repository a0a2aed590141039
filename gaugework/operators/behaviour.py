"""Response checks: sentence limit, contradictions, concepts, fact contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.text import contains_any, sentence_count, word_set


def response_status(
    normalized: Column,
    term_groups: Sequence[Sequence[str]] = rules.CONCEPT_TERM_GROUPS,
    contradictions: Sequence[str] = rules.CONTRADICTION_PHRASES,
    maximum_sentences: int = rules.MAXIMUM_SENTENCES,
) -> Column:
    """verified / contradicted / not-verified for one normalised response.

    The sentence limit comes first, contradictions second, concepts last.
    """
    words = word_set(normalized)
    concepts = F.lit(True)
    for group in term_groups:
        concepts = concepts & F.arrays_overlap(words, F.array(*[F.lit(t) for t in group]))
    too_long = sentence_count(normalized) > maximum_sentences
    return (
        F.when(normalized.isNull() | (normalized == "") | too_long, "not-verified")
        .when(contains_any(normalized, contradictions), "contradicted")
        .when(concepts, "verified")
        .otherwise("not-verified")
    )


def vote(df: DataFrame, keys: Sequence[str], status: str, minimum: int) -> DataFrame:
    """Any contradiction fails; enough verified attempts pass; else manual review."""
    counted = df.groupBy(*keys).agg(
        F.count_if(F.col(status) == "verified").alias("verified"),
        F.count_if(F.col(status) == "contradicted").alias("contradicted"),
        F.count_if(F.col(status) == "not-verified").alias("not_verified"),
    )
    return counted.withColumn(
        "behaviour", vote_status(F.col("verified"), F.col("contradicted"), minimum)
    )


def vote_status(verified: Column, contradicted: Column, minimum: int) -> Column:
    return (
        F.when(contradicted > 0, "fail")
        .when(verified >= minimum, "pass")
        .otherwise("manual-review")
    )


def vote_reasons(status: Column) -> Column:
    return (
        F.when(status == "fail", F.array(F.lit("behavior-contradicted")))
        .when(status == "manual-review", F.array(F.lit("behavior-not-verified")))
        .otherwise(F.array().cast("array<string>"))
    )


def substring_conformant(normalized: Column) -> Column:
    """The older, looser rule: substrings instead of whole words."""
    local = normalized.contains("safe") & contains_any(normalized, ("iphone", "device", "local"))
    sync = (
        normalized.contains("sync")
        & contains_any(normalized, ("connect", "network", "online"))
        & contains_any(normalized, ("return", "restore", "available", "back", "again"))
    )
    within = sentence_count(normalized) <= rules.MAXIMUM_SENTENCES
    return F.coalesce((normalized != "") & within & local & sync, F.lit(False))


def five_facts(text: Column) -> dict[str, Column]:
    """The five facts an answer about the fixed context document must contain."""
    value = F.coalesce(F.lower(text), F.lit(""))
    has = lambda *terms: contains_any(value, terms)
    return {
        "has_reference_code": has("orchid-47"),
        "has_local_safety_fact": has("safe") & has("local", "vault", "iphone"),
        "has_stable_network_fact": has("30") & has("stable", "seconds"),
        "has_battery_power_fact": has("20", "15") & has("power", "charg"),
        "has_avoidance_fact": has("do not", "don't", "avoid", "shouldn't")
        & has("delete", "reinstall", "sign out"),
    }


def fragment_hits(text: Column, fragments: Sequence[str]) -> Column:
    """Which of the fixed fragments occur in the lower-cased text."""
    lowered = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(lowered.contains(f), F.lit(f)) for f in fragments])
    )
