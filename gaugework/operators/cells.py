"""Exact comparison cells: contributor weighting, state, variation, display, rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.operators.hot_keys import lookup
from gaugework.operators.ordered import exact_median, last_rows, number_rows


def contributor_medians(
    runs: DataFrame, cell: Sequence[str], contributor: str, value: str, count: str | None = None
) -> DataFrame:
    """One median per (cell, contributor), with the number of runs behind it.

    `count` names a column that says how many runs a row stands for.
    """
    number = F.count(value) if count is None else F.sum(F.when(F.col(value).isNotNull(), F.col(count)))
    return exact_median(
        runs, [*cell, contributor], value, "contributor_value", {"runs": (number, F.sum)}, count
    )


def weighted_cells(medians: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Each contributor counts once: median of the contributor medians."""
    return exact_median(
        medians,
        cell,
        "contributor_value",
        "value",
        {"contributors": (F.count("contributor_value"), F.sum), "runs": (F.sum("runs"), F.sum)},
    )


def evidence_state(contributors: Column) -> Column:
    return (
        F.when(contributors >= rules.WEIGHTED_CONTRIBUTORS, "contributor-weighted")
        .when(contributors >= rules.REPRODUCED_CONTRIBUTORS, "reproduced")
        .otherwise("accepted")
    )


def community_status(eligible_contributors: Column) -> Column:
    return F.when(
        eligible_contributors >= rules.REPRODUCED_CONTRIBUTORS, "reproduced"
    ).otherwise("single-contributor")


def aggregate_status(eligible_contributors: Column) -> Column:
    return F.when(
        eligible_contributors >= rules.WEIGHTED_CONTRIBUTORS, "community-aggregate"
    ).otherwise("provisional")


def still_needed(eligible_contributors: Column) -> Column:
    """Independent contributors a cell still lacks to count as reproduced."""
    return F.greatest(F.lit(0), rules.REPRODUCED_CONTRIBUTORS - eligible_contributors)


def rank_cells(
    cells: DataFrame,
    view: Sequence[str],
    value: str,
    higher_is_better: bool,
    tie_break: Sequence[str],
    name: str = "rank",
) -> DataFrame:
    """Ranks 1..n per view without gaps or ties."""
    best_first = F.desc(value) if higher_is_better else F.asc(value)
    return number_rows(cells, view, [best_first, *[F.col(c) for c in tie_break]], name)


def relative_variation(medians: DataFrame, cell: Sequence[str], contributor: str) -> DataFrame:
    """Relative median absolute deviation (%) over the contributor medians of a cell.

    Null below two contributors; a zero centre gives 0 only when all are zero.
    """
    value = F.col("contributor_value")
    centres = exact_median(
        medians,
        cell,
        "contributor_value",
        "centre",
        {"contributors": (F.count(value), F.sum), "_all_zero": (F.bool_and(value == 0), F.bool_and)},
    )
    distances = lookup(medians, centres, cell, "inner", [contributor]).withColumn(
        "_distance", F.abs(value - F.col("centre"))
    )
    spread = exact_median(
        distances,
        cell,
        "_distance",
        "_mad",
        {n: (F.max(n), F.max) for n in ("centre", "contributors", "_all_zero")},
    )
    percent = (
        F.when(F.col("contributors") < 2, F.lit(None))
        .when((F.col("centre") == 0) & F.col("_all_zero"), F.lit(0.0))
        .when(F.col("centre") == 0, F.lit(None))
        .otherwise(F.col("_mad") / F.abs("centre") * 100)
    )
    return spread.select(
        *cell,
        "contributors",
        percent.alias("variation_percent"),
        F.coalesce(percent > rules.HIGH_VARIATION_PERCENT, F.lit(False)).alias("high_variation"),
    )


def field_summary(
    runs: DataFrame,
    cell: Sequence[str],
    contributor: str,
    fields: dict[str, str | None],
) -> DataFrame:
    """Weighted value per (cell, field); each field uses only its own eligible runs.

    `fields` maps a value column to its eligibility column, or to None when
    the field has no gate.
    """
    entries = [
        F.struct(
            F.lit(name).alias("field"),
            (F.when(F.col(gate), F.col(name)) if gate else F.col(name))
            .cast("double")
            .alias("field_value"),
        )
        for name, gate in fields.items()
    ]
    long = runs.select(*cell, contributor, F.explode(F.array(*entries)).alias("_e")).select(
        *cell, contributor, "_e.*"
    )
    keys = [*cell, "field"]
    medians = contributor_medians(long, keys, contributor, "field_value")
    return weighted_cells(medians, keys)


def worst_state(df: DataFrame, keys: Sequence[str], state: str, order: Sequence[str]) -> DataFrame:
    """The worst state per key; a state outside `order` ranks with the last one."""
    position = F.lit(len(order) - 1)
    for i, name in enumerate(order):
        position = F.when(F.col(state) == name, F.lit(i)).otherwise(position)
    worst = df.groupBy(*keys).agg(F.max(position).alias("_worst"))
    names = F.array(*[F.lit(name) for name in order])
    return worst.select(*keys, F.element_at(names, F.col("_worst") + 1).alias("worst_state"))


def current_display(
    cells: DataFrame, family: Sequence[str], newest: Sequence[str | Column]
) -> DataFrame:
    """Newest cell of each display family, chosen before rank eligibility is looked at."""
    return last_rows(cells, family, newest)


def first_spellings(
    runs: DataFrame, keys: Sequence[str], name: str, order: Sequence[str]
) -> DataFrame:
    """First spelling of `name` per (keys, folded name), numbered by folded name."""
    folded = runs.withColumn("contributor_key", F.lower(name))
    first = folded.groupBy(*keys, "contributor_key").agg(
        F.min_by(F.col(name), F.struct(*order)).alias("contributor")
    )
    return number_rows(first, keys, [F.col("contributor_key")], "position")
