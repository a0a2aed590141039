"""Batches of changed files: scope, completeness, and the class of the whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework import rules
from gaugework.functions.identity import UUID_PATTERN
from gaugework.functions.numbers import reasons
from gaugework.sources.packages import PACKAGE_FILES


def scope(changes: DataFrame, intake: str) -> DataFrame:
    """Per batch: does it touch the intake, and what breaks the result-only rule.

    changes: batch_id, status (A added, M modified, ...), path.
    """
    depth = len(intake.split("/"))
    parts = F.split("path", "/")
    inside = F.col("path").startswith(intake + "/")
    result_only = (
        (F.col("status") == "A")
        & inside
        & (F.size(parts) == depth + 2)
        & F.element_at(parts, -1).isin(*PACKAGE_FILES)
    )
    folder = F.try_element_at(parts, F.lit(-2))
    marked = changes.select(
        "batch_id",
        inside.alias("inside"),
        result_only.alias("in_scope"),
        (result_only & folder.rlike(UUID_PATTERN)).alias("named"),
        folder.alias("package_id"),
        F.element_at(parts, -1).alias("file"),
    )
    packages = (
        marked.where("named")
        .groupBy("batch_id", "package_id")
        .agg(F.countDistinct("file").alias("_files"))
        .groupBy("batch_id")
        .agg(
            F.count("*").alias("packages"),
            F.count_if(F.col("_files") < len(PACKAGE_FILES)).alias("incomplete"),
        )
    )
    batches = marked.groupBy("batch_id").agg(
        F.bool_or("inside").alias("touches_intake"),
        F.count_if(~F.col("in_scope")).alias("_outside"),
        F.count_if(F.col("in_scope") & ~F.col("named")).alias("_misnamed"),
    )
    n = F.coalesce("packages", F.lit(0))
    errors = reasons(
        (F.col("_outside") > 0, "non-result-only-change"),
        (F.col("_misnamed") > 0, "invalid-submission-directory-name"),
        (n == 0, "no-package-added"),
        (n > rules.MAXIMUM_PACKAGES_PER_BATCH, "too-many-packages"),
        (F.coalesce("incomplete", F.lit(0)) > 0, "incomplete-package"),
    )
    return batches.join(packages, "batch_id", "left").select(
        "batch_id", "touches_intake", n.alias("packages"), errors.alias("errors")
    )


def triage(scoped: DataFrame, decided: DataFrame) -> DataFrame:
    """Class of every batch; decided: batch_id, classification."""
    verdicts = decided.groupBy("batch_id").agg(
        F.bool_or(F.col("classification") == "reject").alias("_reject"),
        F.bool_or(F.col("classification") == "manual-review").alias("_manual"),
    )
    classification = (
        F.when(~F.col("touches_intake"), "not_applicable")
        .when((F.size("errors") > 0) | F.coalesce("_reject", F.lit(False)), "rejected")
        .when(F.coalesce("_manual", F.lit(False)), "manual_review")
        .otherwise("auto_accept")
    )
    return scoped.join(verdicts, "batch_id", "left").select(
        "batch_id",
        classification.alias("classification"),
        "packages",
        F.when(F.col("touches_intake"), F.col("errors"))
        .otherwise(F.array().cast("array<string>"))
        .alias("errors"),
    )
