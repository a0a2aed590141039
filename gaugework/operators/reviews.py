"""Evidence levels from ordered review records.

A valid record moves its submission one step along unreviewed ->
community-submitted -> reproduced -> verified (or to maintainer-reference),
so at most three records per submission can be valid.  Only the first step
makes a submission count as accepted support, and the first step itself needs
no support.  The ordered fold therefore falls apart into three "earliest
candidate after the previous step" aggregations, with no sequential pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.numbers import reasons
from gaugework.operators.hot_keys import lookup
from gaugework.operators.ordered import number_rows
from gaugework.session import materialize


def transition_allowed(kind: Column, previous: Column, assigned: Column) -> Column:
    return reduce(
        lambda a, b: a | b,
        [
            (kind == k) & (previous == p) & (assigned == a)
            for k, p, a in rules.REVIEW_TRANSITIONS
        ],
    )


def _support_facts(supports: DataFrame, first: DataFrame, record: str) -> DataFrame:
    """Per review: how many supports, all statically fine, and when the last was accepted."""
    accepted = first.select(
        F.col("submission_id").alias("supporting_id"), F.col("_at").alias("_accepted_at")
    )
    both = lookup(supports, accepted, ["supporting_id"], "left", [record])
    return both.groupBy(record).agg(
        F.count("*").alias("_supports"),
        F.bool_and("support_ok").alias("_supports_ok"),
        F.bool_and(F.col("_accepted_at").isNotNull()).alias("_all_accepted"),
        F.max("_accepted_at").alias("_last_accepted"),
    )


def _earliest(candidates: DataFrame, suffix: str) -> DataFrame:
    return candidates.groupBy("submission_id").agg(
        F.min("_at").alias(f"_at{suffix}"),
        F.min_by("assigned_level", "_at").alias(f"_level{suffix}"),
    )


def fold_reviews(
    records: DataFrame, supports: DataFrame, record: str = "review_id", landed: bool = False
) -> DataFrame:
    """Every record with its verdict and the level it found and left behind.

    records: review_id, name, reviewed_at, submission_id, review_type,
    previous_level, assigned_level, static_ok (digests and package checks).
    supports: review_id, supporting_id, support_ok (identity, independence).
    `record` is the column that says which record a support is named by:
    `name` where review ids may repeat.  `landed` records are read from a table.
    """
    order = [F.col("reviewed_at"), F.col("name")]
    numbered = number_rows(records, ["review_id"], order, "_use", landed)
    counts = supports.groupBy(record).agg(
        F.count("*").alias("_n"), F.bool_and("support_ok").alias("_ok")
    )
    known = lookup(numbered, counts, [record], "left", ["name"], records)
    reproduction = F.col("review_type") == "reproduction-review"
    has_supports = F.coalesce(F.col("_n") > 0, F.lit(False))
    # Written once; the moments of a record are put together where they are compared.
    static = materialize(
        known.withColumn(
            "_static",
            F.col("static_ok")
            & (F.col("_use") == 1)
            & transition_allowed(
                F.col("review_type"), F.col("previous_level"), F.col("assigned_level")
            )
            & (reproduction == has_supports)
            & F.coalesce("_ok", F.lit(True)),
        )
    )
    moment = F.struct(*order).alias("_at")
    # The steps are looked for in the few columns they need, and only then meet whole records.
    usable = static.where("_static").select(
        *dict.fromkeys([record, "name", "submission_id", "previous_level", "assigned_level"]), moment
    )
    first = materialize(_earliest(usable.where("previous_level = 'unreviewed'"), "1"))
    facts = materialize(
        _support_facts(supports, first.withColumnRenamed("_at1", "_at"), record).select(
            record, "_all_accepted", "_last_accepted"
        )
    )
    supported = F.col("_all_accepted").isNull() | (
        F.col("_all_accepted") & (F.col("_last_accepted") < F.col("_at"))
    )
    # Rows that a left join would keep without a first step are no candidates: `_level1` is null there.
    second_candidates = lookup(
        usable.where("previous_level = 'community-submitted'"), first, ["submission_id"], "inner", ["name"]
    ).where((F.col("_level1") == "community-submitted") & (F.col("_at") > F.col("_at1")))
    second_candidates = lookup(second_candidates, facts, [record], "left", ["name"], usable).where(supported)
    second = materialize(_earliest(second_candidates, "2"))
    third_candidates = lookup(
        usable.where("previous_level = 'reproduced'"), second, ["submission_id"], "inner", ["name"]
    ).where((F.col("_level2") == "reproduced") & (F.col("_at") > F.col("_at2")))
    third = _earliest(third_candidates, "3")
    steps = materialize(first.join(second, "submission_id", "left").join(third, "submission_id", "left"))
    stepped = lookup(static, steps, ["submission_id"], "left", ["review_id"])
    final = lookup(stepped, facts, [record], "left", ["name"], static).withColumn("_at", moment)
    final = final.withColumn("_supported", supported)
    after = lambda n: F.coalesce(F.col("_at") > F.col(f"_at{n}"), F.lit(False))
    found = (
        F.when(after(3), F.col("_level3"))
        .when(after(2), F.col("_level2"))
        .when(after(1), F.col("_level1"))
        .otherwise("unreviewed")
    )
    chosen = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col("_at") == F.col(f"_at{n}"), F.lit(False)) for n in (1, 2, 3)],
    )
    valid = chosen & F.col("_static")
    level = F.coalesce("_level3", "_level2", "_level1", F.lit("unreviewed"))
    errors = reasons(
        (~F.col("static_ok"), "package-mismatch"),
        (F.col("_use") > 1, "duplicate-review-id"),
        (F.col("previous_level") != found, "previous-level-mismatch"),
        (
            ~transition_allowed(
                F.col("review_type"), F.col("previous_level"), F.col("assigned_level")
            ),
            "transition-not-allowed",
        ),
        (reproduction & ~has_supports, "supporting-submissions-required"),
        (~reproduction & has_supports, "supporting-submissions-not-allowed"),
        (~F.coalesce("_ok", F.lit(True)), "support-invalid"),
        (has_supports & ~F.col("_supported"), "support-not-accepted"),
    )
    return final.select(
        *records.columns,
        valid.alias("valid"),
        found.alias("level_before"),
        level.alias("final_level"),
        errors.alias("errors"),
    )


def evidence_levels(submissions: DataFrame, folded: DataFrame) -> DataFrame:
    """Level of every submission; unreviewed without a valid record."""
    levels = folded.groupBy("submission_id").agg(F.first("final_level").alias("evidence_level"))
    return submissions.join(levels, "submission_id", "left").withColumn(
        "evidence_level", F.coalesce("evidence_level", F.lit("unreviewed"))
    )
