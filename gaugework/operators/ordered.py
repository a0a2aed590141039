"""Order-dependent operators that stay whole when one key holds most rows.

The rows are written to a table once and counted.  Keys of ordinary size get a
plain window (or an aggregate of their values).  A key with more rows than a
slice holds is cut: a range shuffle on (key, order) deals its rows to slices of
bounded size, each slice is summarised to one row, the summaries of the earlier
slices are carried into every slice, and the window runs inside (key, slice).
Which way a key goes follows from its own number of rows, so both ways may work
on one table, and they give the same rows.  Labelled rows are written too,
because a recomputed range shuffle may cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.hot_keys import large_keys
from gaugework.session import materialize, rows_per_slice, slice_count

SLICE = "_slice"

# Further aggregates by name: one over rows, and the function that merges its partial results.
Also = dict[str, tuple[Column, Callable[[str], Column]]]


def _over(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def by_size(
    df: DataFrame,
    keys: Sequence[str],
    plain: Callable[[DataFrame], DataFrame],
    sliced: Callable[[DataFrame], DataFrame],
    landed: bool = False,
) -> DataFrame:
    """`plain` over the keys that fit into one slice, `sliced` over the larger ones.

    `landed` rows are read from tables and cheap to read again, so they are not
    written once more.
    """
    kept = df if landed else materialize(df)
    limit = rows_per_slice(kept)
    if kept.count() <= limit:
        return plain(kept)
    if not keys:
        return sliced(kept)
    found = large_keys(kept, keys, limit)
    if found is None:
        return plain(kept)
    large = materialize(found.select(*[F.col(k).alias(f"_l_{k}") for k in keys]))
    if large.isEmpty():
        return plain(kept)
    same = _same(keys, "_l_")
    rest = plain(kept.join(large, same, "left_anti"))
    return rest.unionByName(sliced(kept.join(large, same, "left_semi")))


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Label every row with the number of its slice in (key, order) order."""
    kept = materialize(df)
    slices = slice_count(kept)
    if slices == 1:
        return kept.withColumn(SLICE, F.lit(0))
    ranged = kept.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()))


def _earlier(keys: Sequence[str]):
    window = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _attach(sliced: DataFrame, carry: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join slice-level values back; (key, slice) groups are bounded by the slice size."""
    names = [*keys, SLICE]
    renamed = carry.select(
        *[F.col(k).alias(f"_c_{k}") for k in names],
        *[F.col(c) for c in carry.columns if c not in names],
    )
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in names]
    )
    return sliced.join(renamed, same, how).drop(*[f"_c_{k}" for k in names])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, landed: bool = False
) -> DataFrame:
    """1-based position of each row inside its key; `order` must be a total order."""

    def sliced(rows: DataFrame) -> DataFrame:
        cut = ordered_slices(rows, keys, order)
        counts = cut.groupBy(*keys, SLICE).agg(F.count("*").alias("_rows"))
        carry = counts.select(*keys, SLICE, F.sum("_rows").over(_earlier(keys)).alias("_before"))
        inside = F.row_number().over(_over([*keys, SLICE], order))
        return (
            _attach(cut, carry, keys)
            .withColumn(name, F.coalesce("_before", F.lit(0)) + inside)
            .drop("_before", SLICE)
        )

    number = F.row_number().over(_over(keys, order)).cast("long")
    return by_size(df, keys, lambda rows: rows.withColumn(name, number), sliced, landed)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, sums: dict[str, str]
) -> DataFrame:
    """`number_rows`, and for each {new name: column} the sum of the column up to this row."""
    totals = {name: F.lit(1).cast("long"), **{n: F.coalesce(F.col(c), F.lit(0)) for n, c in sums.items()}}
    upto = lambda cols: _over(cols, order).rowsBetween(Window.unboundedPreceding, 0)

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(*df.columns, *[F.sum(c).over(upto(keys)).alias(n) for n, c in totals.items()])

    def sliced(rows: DataFrame) -> DataFrame:
        cut = ordered_slices(rows, keys, order)
        parts = cut.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
        carry = parts.select(
            *keys, SLICE, *[F.sum(f"_{n}").over(_earlier(keys)).alias(f"_before_{n}") for n in totals]
        )
        inside = upto([*keys, SLICE])
        whole = {n: F.coalesce(f"_before_{n}", F.lit(0)) + F.sum(c).over(inside) for n, c in totals.items()}
        return _attach(cut, carry, keys).select(*df.columns, *[c.alias(n) for n, c in whole.items()])

    return by_size(df, keys, plain, sliced)


def running_any(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    flag: str,
    name: str,
    include_current: bool = True,
) -> DataFrame:
    """True once `flag` was true on an earlier row (or this one) of the key."""
    last = 0 if include_current else -1
    upto = lambda cols: _over(cols, order).rowsBetween(Window.unboundedPreceding, last)
    seen_in = lambda cols: F.coalesce(F.bool_or(flag).over(upto(cols)), F.lit(False))

    def sliced(rows: DataFrame) -> DataFrame:
        cut = ordered_slices(rows, keys, order)
        seen = cut.groupBy(*keys, SLICE).agg(F.bool_or(flag).alias("_any"))
        carry = seen.select(*keys, SLICE, F.bool_or("_any").over(_earlier(keys)).alias("_before"))
        return (
            _attach(cut, carry, keys)
            .withColumn(name, F.coalesce("_before", F.lit(False)) | seen_in([*keys, SLICE]))
            .drop("_before", SLICE)
        )

    return by_size(df, keys, lambda rows: rows.withColumn(name, seen_in(keys)), sliced)


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str]
) -> DataFrame:
    """Add, for each {new name: column}, its value on the previous row of the key."""

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(
            *df.columns, *[F.lag(c).over(_over(keys, order)).alias(n) for n, c in columns.items()]
        )

    def sliced(rows: DataFrame) -> DataFrame:
        cut = ordered_slices(rows, keys, order)
        inside = _over([*keys, SLICE], order)
        # The last row of a slice has no successor inside it; one such row per slice.
        tails = (
            cut.withColumn("_next", F.lead(F.lit(True)).over(inside))
            .where(F.col("_next").isNull())
            .select(*keys, SLICE, F.struct(*sorted(set(columns.values()))).alias("_tail"))
        )
        across = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(SLICE)
        carry = tails.select(*keys, SLICE, F.lag("_tail").over(across).alias("_before"))
        joined = _attach(cut, carry, keys).withColumn("_first", F.row_number().over(inside) == 1)
        return joined.select(
            *df.columns,
            *[
                F.when(F.col("_first"), F.col("_before")[c])
                .otherwise(F.lag(c).over(inside))
                .alias(n)
                for n, c in columns.items()
            ],
        )

    return by_size(df, keys, plain, sliced)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    strict: bool = True,
    landed: bool = False,
) -> DataFrame:
    """Every row of `left` with the `values` of the last `right` row of its key before its moment.

    `at` names the moment in both frames; with `strict` a row of the same moment
    comes too late.  Of right rows with one moment the one with the greatest
    values counts; a null moment finds nothing and is never found.
    """
    row = F.struct(*[F.col(c) for c in left.columns])
    asked = left.select(*keys, F.col(at).alias("_at"), row.alias("_row"))
    told = right.where(F.col(at).isNotNull()).select(
        *keys, F.col(at).alias("_at"), F.struct(*values).alias("_held")
    )
    both = asked.unionByName(told, allowMissingColumns=True)
    late = F.col("_held").isNotNull() if strict else F.col("_held").isNull()
    order = [F.col("_at"), late.cast("int"), F.col("_held")]
    newest_in = lambda cols: F.last("_held", ignorenulls=True).over(
        _over(cols, order).rowsBetween(Window.unboundedPreceding, 0)
    )
    asked_rows = lambda found: found.where(F.col("_row").isNotNull()).select("_row.*", "_found.*")

    def sliced(rows: DataFrame) -> DataFrame:
        cut = ordered_slices(rows, keys, order)
        newest = F.when(F.col("_held").isNotNull(), F.struct(F.col("_at"), F.col("_held")))
        ends = cut.groupBy(*keys, SLICE).agg(F.max_by("_held", newest).alias("_end"))
        earlier = F.last("_end", ignorenulls=True).over(_earlier(keys))
        carry = ends.select(*keys, SLICE, earlier.alias("_before"))
        found = F.coalesce(newest_in([*keys, SLICE]), "_before")
        return asked_rows(_attach(cut, carry, keys).withColumn("_found", found))

    return by_size(
        both, keys, lambda rows: asked_rows(rows.withColumn("_found", newest_in(keys))), sliced, landed
    )


def beside(*single_rows: DataFrame) -> DataFrame:
    """One row out of several one-row frames with different columns, without a join."""
    columns = [c for frame in single_rows for c in frame.columns]
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), single_rows
    )
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


def _interpolated(found, keys, fractions, columns) -> DataFrame:
    names = []
    for n, fraction in fractions.items():
        position = fraction * (F.col("_all") - 1)
        share = position - F.floor(position)
        low, high = F.col(f"_lo_{n}"), F.col(f"_hi_{n}")
        names.append(
            F.when(share == 0, low).otherwise(low * (1 - share) + high * share).alias(n)
        )
    return found.select(*keys, *names, *columns)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: dict[str, float],
    also: Also | None = None,
    count: str | None = None,
    together: Sequence[str] = (),
) -> DataFrame:
    """One row per key with exact, linearly interpolated percentiles of `value`.

    Keys whose values are all null keep a row with null percentiles.  The input
    is read once: everything else works on its distinct (key, value) rows.
    `count` names a column that says how often a row counts; once by default.

    With `together`, some of the keys, the input is read twice and written never:
    its rows are counted by them, and go straight to their task by them.  That
    suits many small groups, whose values are nearly all distinct.
    """
    also = also or {}
    if together:
        return _together(df, keys, value, fractions, also, count, together)
    number = F.col(value).cast("double")
    counted = df.groupBy(*keys, number.alias("_v")).agg(
        (F.sum(count) if count else F.count("*")).alias("_n"),
        *[first.alias(f"_also_{n}") for n, (first, _) in also.items()],
    )
    merged = [merge(f"_also_{n}").alias(n) for n, (_, merge) in also.items()]

    def plain(distinct: DataFrame) -> DataFrame:
        # Null values count for nothing, but keep their key.
        often = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
        parts = F.percentile("_v", [*fractions.values()], often).alias("_p")
        found = distinct.groupBy(*keys).agg(parts, *merged)
        return found.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(fractions)], *also)

    return by_size(counted, keys, plain, lambda distinct: _sliced_percentiles(distinct, keys, fractions, also, merged))


def _together(df, keys, value, fractions, also, count, together) -> DataFrame:
    number = F.col(value).cast("double")
    often = F.when(number.isNotNull(), F.coalesce(count, F.lit(0)) if count else F.lit(1)).otherwise(0)

    def direct(rows: DataFrame) -> DataFrame:
        found = rows.repartition(*together).groupBy(*keys).agg(
            F.percentile(number, [*fractions.values()], often).alias("_p"),
            *[first.alias(n) for n, (first, _) in also.items()],
        )
        return found.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(fractions)], *also)

    large = large_keys(df, together, rows_per_slice(df))
    if large is None:
        return direct(df)
    # At most rows / limit keys, so their list goes to every task.
    large = F.broadcast(large.select(*[F.col(k).alias(f"_l_{k}") for k in together]))
    same = _same(together, "_l_")
    others = exact_percentiles(df.join(large, same, "left_semi"), keys, value, fractions, also, count)
    return direct(df.join(large, same, "left_anti")).unionByName(others)


def _sliced_percentiles(counted, keys, fractions, also, merged) -> DataFrame:
    distinct = ordered_slices(counted, keys, [F.col("_v")])
    sliced = distinct.where(F.col("_v").isNotNull())
    totals = sliced.groupBy(*keys, SLICE).agg(F.sum("_n").alias("_rows"))
    everything = Window.partitionBy(*keys) if keys else Window.partitionBy()
    spans = totals.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_rows").over(_earlier(keys)), F.lit(0)).alias("_before"),
        "_rows",
        F.sum("_rows").over(everything).alias("_all"),
    )
    ranks = {
        n: (F.floor(f * (F.col("_all") - 1)), F.ceil(f * (F.col("_all") - 1)))
        for n, f in fractions.items()
    }
    wanted = [rank for pair in ranks.values() for rank in pair]
    holds = lambda rank, start, size: (rank >= start) & (rank < start + size)
    any_of = lambda start, size: reduce(
        lambda a, b: a | b, [holds(r, start, size) for r in wanted]
    )
    # Only the one or two slices around each requested rank are read again.
    hit = spans.where(any_of(F.col("_before"), F.col("_rows"))).drop("_rows")
    inside = _over([*keys, SLICE], [F.col("_v")]).rowsBetween(Window.unboundedPreceding, -1)
    placed = _attach(sliced, hit, keys, "inner").withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    picked = placed.where(any_of(F.col("_start"), F.col("_n")))
    at = lambda rank: F.max(F.when(holds(rank, F.col("_start"), F.col("_n")), F.col("_v")))
    aggregates = [F.max("_all").alias("_all")]
    for n, (low, high) in ranks.items():
        aggregates += [at(low).alias(f"_lo_{n}"), at(high).alias(f"_hi_{n}")]
    found = picked.groupBy(*keys).agg(*aggregates)
    result = _interpolated(found, keys, fractions, [])
    rest = distinct.groupBy(*keys).agg(F.sum("_n").alias("_rows"), *merged)
    if not keys:
        return beside(rest.drop("_rows"), result)
    renamed = result.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *fractions)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys])
    return rest.join(renamed, same, "left").select(*keys, *fractions, *also)


def exact_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    also: Also | None = None,
    count: str | None = None,
    together: Sequence[str] = (),
) -> DataFrame:
    return exact_percentiles(df, keys, value, {name: 0.5}, also, count, together)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in ascending `order`; partial aggregation, no window."""
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    )
    return best.select("_row.*")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row per key in ascending `order`."""
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    )
    return best.select("_row.*")
