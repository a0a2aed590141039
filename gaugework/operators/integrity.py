"""Duplicates, digests, registries and set coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.numbers import reasons
from gaugework.operators.hot_keys import lookup
from gaugework.operators.ordered import number_rows


def fixed_rows(spark, columns: Sequence[str], rows) -> DataFrame:
    """A small policy table from literal rows, kept inside the JVM."""
    structs = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row, strict=True)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def first_wins(
    df: DataFrame, digest: str, order: Sequence[str], name: str = "duplicate"
) -> DataFrame:
    """Every earlier row with the digest blocks a later one, rejected rows included."""
    numbered = number_rows(df, [digest], [F.col(c) for c in order], "_seen")
    return numbered.withColumn(name, F.col("_seen") > 1).drop("_seen")


def first_valid_wins(
    df: DataFrame, identifier: str, order: Sequence[str], valid: str, name: str = "status"
) -> DataFrame:
    """Only valid rows claim an identifier; later valid rows with it are duplicates."""
    claims = number_rows(
        df, [identifier, valid], [F.col(c) for c in order], "_seen"
    )
    status = (
        F.when(~F.col(valid), "invalid").when(F.col("_seen") > 1, "duplicate").otherwise("accepted")
    )
    return claims.withColumn(name, status).drop("_seen")


def repeated_values(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, value, rows) for every value that occurs more than once."""
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("field"), c.cast("string").alias("value"))
            for n, c in fields.items()
        ]
    )
    return (
        df.select(F.explode(pairs).alias("_p"))
        .select("_p.*")
        .where(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count("*").alias("rows"))
        .where(F.col("rows") > 1)
    )


def against_registry(
    facts: DataFrame,
    registry: DataFrame,
    keys: Sequence[str],
    same: Sequence[tuple[str, str]],
    unknown: str,
    mismatch: str,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Add `reason`: unknown entry, differing identity fields, or null."""
    known = registry.withColumn("_known", F.lit(True))
    both = lookup(facts, known, keys, "left", spread_by)
    equal = reduce(
        lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in same], F.lit(True)
    )
    reason = F.when(F.col("_known").isNull(), unknown).when(~equal, mismatch)
    return both.withColumn("reason", reason).drop("_known")


def against_trusted(groups: Sequence[tuple[list[tuple[Column, object]], str]]) -> Column:
    """Reason codes of trusted single-row identities that differ (null-safe)."""
    checks = []
    for fields, code in groups:
        equal = reduce(lambda a, b: a & b, [c.eqNullSafe(F.lit(v)) for c, v in fields])
        checks.append((~equal, code))
    return reasons(*checks)


def first_approval(
    facts: DataFrame, approvals: DataFrame, keys: Sequence[str], position: str, name: str
) -> DataFrame:
    """Null-safe match on several keys; of several approvals the first in policy order."""
    chosen = approvals.groupBy(*[F.col(k).alias(f"_a_{k}") for k in keys]).agg(
        F.min_by(name, position).alias(name)
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in keys])
    return facts.join(chosen, same, "left").drop(*[f"_a_{k}" for k in keys])


def against_pins(
    declared: DataFrame, actual: DataFrame, path: str, digest: str = "sha256"
) -> DataFrame:
    """Declared (path, digest) pins against the digests of what is there."""
    found = actual.select(path, F.col(digest).alias("_actual"))
    state = (
        F.when(F.col("_actual").isNull(), "missing")
        .when(F.col("_actual") != F.col(digest), "digest-mismatch")
        .otherwise("ok")
    )
    return declared.join(found, path, "left").withColumn("state", state).drop("_actual")


def list_coverage(listed: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only: `missing` are not listed, `stale` are not there."""
    left = listed.select(*keys).distinct().withColumn("_listed", F.lit(True))
    right = actual.select(*keys).distinct().withColumn("_actual", F.lit(True))
    state = F.when(F.col("_listed").isNull(), "missing").when(F.col("_actual").isNull(), "stale")
    both = left.join(right, list(keys), "full_outer").withColumn("state", state)
    return both.where(F.col("state").isNotNull()).drop("_listed", "_actual")


def set_difference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows only left, rows only right, and whether the multisets are equal."""
    sides = left.exceptAll(right).select(F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.exceptAll(left).select(F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    only = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sides.agg(only("_l").alias("only_left"), only("_r").alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0)
    )


def author_check(declared: Column, author: Column) -> tuple[Column, Column]:
    """Status and reason: the author must be the declared contributor, case-insensitively."""
    status = (
        F.when(author.isNull(), "manual-review")
        .when(declared.isNull() | (F.lower(declared) != F.lower(author)), "fail")
        .otherwise("pass")
    )
    reason = (
        F.when(author.isNull(), "contributor-identity-unavailable")
        .when(declared.isNull() | (F.lower(declared) != F.lower(author)),
              "contributor-identity-mismatch")
    )
    return status, reason


def support_reasons(
    same_identity: Column,
    same_contributor: Column,
    same_result: Column,
    accepted: Column,
    same_session: Column | None = None,
) -> Column:
    """Why a named supporting submission does not count."""
    return reasons(
        (~accepted, "support-not-accepted"),
        (~same_identity, "support-not-comparison-compatible"),
        (same_contributor, "support-not-contributor-independent"),
        (same_result, "support-reuses-result"),
        *([] if same_session is None else [(same_session, "support-reuses-session")]),
    )
