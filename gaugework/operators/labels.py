"""Labelled cases against evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_cases(cases: DataFrame, evaluations: DataFrame, key: str) -> DataFrame:
    """Full pairing; `problem` names a side without its counterpart."""
    left = cases.withColumn("_case", F.lit(True))
    right = evaluations.withColumn("_evaluation", F.lit(True))
    problem = F.when(F.col("_case").isNull(), "evaluation-without-case").when(
        F.col("_evaluation").isNull(), "case-without-evaluation"
    )
    both = left.join(right, key, "full_outer")
    return both.withColumn("problem", problem).drop("_case", "_evaluation")


def confusion(df: DataFrame, keys: Sequence[str], expected: str, actual: str) -> DataFrame:
    return df.groupBy(*keys, expected, actual).agg(F.count("*").alias("cases"))


def accuracy(df: DataFrame, keys: Sequence[str], expected: str, actual: str) -> DataFrame:
    match = F.col(expected).eqNullSafe(F.col(actual))
    return df.groupBy(*keys).agg(
        F.count_if(match).alias("correct"),
        F.count("*").alias("total"),
        F.round(F.count_if(match) / F.count("*"), 6).alias("accuracy"),
    )


def label_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("cases"))


def case_problems(cases: DataFrame, case_id: str, response: str, label: str, allowed) -> DataFrame:
    """Rows that may not enter the corpus: blank fields, unknown labels, repeated ids."""
    repeats = cases.groupBy(case_id).agg(F.count("*").alias("_n"))
    both = cases.join(repeats, case_id, "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    problem = (
        F.when(blank(case_id), "blank-case-id")
        .when(blank(response), "blank-response")
        .when(~F.coalesce(F.col(label).isin(list(allowed)), F.lit(False)), "unknown-label")
        .when(F.col("_n") > 1, "duplicate-case-id")
    )
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_n")
