"""Equi joins whose fact side may have a key with a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys with more rows than this are split.
ROWS_PER_SALT = 1_000_000
# Rows are first counted by this many hash values of their key, which costs no shuffle of the keys.
BUCKETS = 65_536
# A table of at most so many rows goes to every task.
SMALL_ROWS = 100_000


def small(table: DataFrame) -> bool:
    """Whether the table can go to every task; no more than that many of its rows are looked at."""
    return table.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def large_keys(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """(keys, _n) of the keys with more than `limit` rows, None if there are none.

    Only rows in a hash bucket with more than `limit` rows are counted by key:
    every large key is in such a bucket, and there are at most rows / limit.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    full = rows.groupBy(bucket).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    buckets = [r["_bucket"] for r in full.select("_bucket").collect()]
    if not buckets:
        return None
    return (
        rows.where(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).isin(buckets))
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > limit)
    )


def lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = (),
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join each fact row to at most one row of `table` on equally named keys.

    Every key with more than ROWS_PER_SALT rows is split over copies of its table
    row; there are at most rows / ROWS_PER_SALT such keys, so their list goes to
    every task.  All other keys have one copy, and without any such key this is
    a plain join, whose partitions later steps on the same keys can use.
    `spread_by` names columns that identify a fact row; without it the join is
    left to the optimizer.  The keys are counted in `counted` if given: a frame
    with the same keys as often, but cheaper to read than `facts`.
    """
    if not spread_by:
        return facts.join(table, list(keys), how)
    large = large_keys(facts if counted is None else counted, keys, ROWS_PER_SALT)
    if large is None:
        return facts.join(table, list(keys), how)
    hot = F.broadcast(large.select(*keys, F.ceil(F.col("_n") / ROWS_PER_SALT).cast("int").alias("_copies")))
    salted = facts.join(hot, list(keys), "left").withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_copies")).cast("int"), F.lit(0)),
    )
    copies = table.join(hot, list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    )
    return salted.drop("_copies").join(
        copies.drop("_copies"), [*keys, "_salt"], how
    ).drop("_salt")
