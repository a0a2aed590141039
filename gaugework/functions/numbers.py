"""Numeric expressions shared by the metric and comparison jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_MS = 1e6
NS_PER_SECOND = 1e9
BYTES_PER_MIB = 1048576.0


def is_finite(value: Column) -> Column:
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null when the divisor is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent_change(first: Column, last: Column) -> Column:
    return ratio(last - first, first) * 100


def close_enough(reported: Column, expected: Column, absolute: float) -> Column:
    """Both null, or finite and within relative 1e-6 / the absolute tolerance."""
    size = F.greatest(F.abs(reported), F.abs(expected))
    near = is_finite(reported) & (
        F.abs(reported - expected) <= F.greatest(size * 1e-6, F.lit(absolute))
    )
    return F.when(expected.isNull(), reported.isNull()).otherwise(F.coalesce(near, F.lit(False)))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, first-seen order, without repeats."""
    codes = F.array(*[F.when(condition, F.lit(code)) for condition, code in checks])
    return F.array_distinct(F.array_compact(codes))


def joined(codes: Column) -> Column:
    return F.array_join(codes, ",")
