"""Flat score records: path states, checks, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.numbers import is_finite, reasons
from gaugework.operators.ordered import number_rows

# Enumerations of the flat record.
ACCESS_TYPES = ("api", "local", "xcode", "hosted", "unknown")
RUN_TYPES = ("manual", "scripted", "app-export", "ci", "unknown")
SOURCES = (
    "manual-submission",
    "benchmark-app",
    "maintainer-run",
    "ci",
    "imported",
    "demo-placeholder",
)
PLACEHOLDER = "demo-placeholder"


def path_state(document: Column, path: str) -> Column:
    """missing / null / empty / present for a dotted path of a variant document."""
    value = F.try_variant_get(document, f"$.{path}", "variant")
    text = F.try_variant_get(document, f"$.{path}", "string")
    return (
        F.when(value.isNull(), "missing")
        .when(F.is_variant_null(value), "null")
        .when(F.schema_of_variant(value).eqNullSafe("STRING") & (F.trim(text) == ""), "empty")
        .otherwise("present")
    )


def path_problems(
    df: DataFrame, keys: Sequence[str], document: str, paths: Sequence[str], allow_null: Column
) -> DataFrame:
    """(keys, path, state) for required paths that are missing, null or empty."""
    states = F.array(
        *[
            F.struct(F.lit(p).alias("path"), path_state(F.col(document), p).alias("state"))
            for p in paths
        ]
    )
    long = df.select(*keys, allow_null.alias("_allowed"), F.explode(states).alias("_s"))
    return (
        long.select(*keys, "_allowed", "_s.*")
        .where((F.col("state") != "present") & ~((F.col("state") == "null") & F.col("_allowed")))
        .drop("_allowed")
    )


def publishable(source: Column) -> Column:
    return ~source.eqNullSafe(PLACEHOLDER)


def score_reasons(
    score: Column, maximum: Column, passed: Column, source: Column, thermal: Column, metrics
) -> Column:
    """Checks of score, maximum, pass flag, enumerations and primary metrics."""
    placeholder = ~publishable(source)
    scored = is_finite(score)
    outside = scored & is_finite(maximum) & ~((score >= 0) & (score <= maximum))
    known = lambda value, names: value.isNull() | value.isin(list(names))
    some_metric = F.coalesce(*[m.cast("string") for m in metrics], thermal).isNotNull()
    return reasons(
        (~is_finite(maximum), "max-score-not-finite"),
        (is_finite(maximum) & (maximum <= 0), "max-score-not-positive"),
        (score.isNull() & ~placeholder, "score-missing"),
        (score.isNotNull() & ~scored, "score-not-finite"),
        (outside, "score-out-of-range"),
        (passed.isNull() & ~placeholder, "passed-missing"),
        (~known(source, SOURCES), "source-unsupported"),
        (~known(thermal, rules.THERMAL_ORDER), "thermal-state-unsupported"),
        (~placeholder & ~some_metric, "primary-metric-missing"),
    )


def suite_position(suite: Column, order: Sequence[str]) -> Column:
    """Known suites first in their fixed order, the others after them."""
    position = F.lit(len(order))
    for i, name in enumerate(order):
        position = F.when(suite == name, F.lit(i)).otherwise(position)
    return position


def scored_listing(df: DataFrame, suite: str, score: str, path: str) -> DataFrame:
    """Descending score per suite; equal scores keep the input path order."""
    return number_rows(df, [suite], [F.desc_nulls_last(score), F.col(path)], "rank")


def natural_key(text: Column) -> Column:
    """Case-insensitive, number-aware sort text: digit runs compare by value."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    # a longer run is a larger number, so its length comes first
    by_length = lambda digits: F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
    padded = F.transform(
        parts,
        lambda p: F.when(
            p.rlike(r"^\d"), by_length(F.regexp_replace(p, "^0+(?=.)", ""))
        ).otherwise(p),
    )
    return F.array_join(padded, "")
