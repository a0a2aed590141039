"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its words is the number of copies of each of its
documents: a whole part that every document gets, and one fraction f that all
share.  A document of s words then holds a mass of f * s words, and the masses
are rounded to 0 or s in pairs: mass moves from one document of a pair to the
other until one of them is whole, in a direction drawn so that no document's
expected mass changes.  The sum of the masses never changes, so however sizes
differ a source ends within half a document of its target.

Documents are dealt by hash into groups of about GROUP, a group is swept from
its largest document to its smallest, and the one document it leaves unsettled
goes up a tree that joins GROUP groups at every level.  The last of a source has
no partner and is rounded to the nearer side.  Everything is DataFrame functions.

Nulls, empty texts and texts of separators have no words, take part in no
rounding and are taken with 0 words.  A null source is a source, the last one;
null and repeated ids are ordinary documents: rows alike in source, id and size
are counted before they are dealt, so they never meet in one group.  An empty
table gives no rows, and a source without words has the target 0.  Texts are
reduced to a count where they are read, and only the columns doc_id, source and
text are read.  Draws hash the place in the tree and no partition, so a rerun
gives the same rows whatever the layout of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import materialize
from gaugework.operators.ordered import number_rows

GROUP = 64
SEED = 13
SEPARATORS = " \t\n\x0b\x0c\r"
WORD_AND_GAP = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def word_count(text: Column) -> Column:
    """Number of runs of non-separators; a letter stands for each word, so no array is built."""
    letters = F.ltrim(F.regexp_replace(text, WORD_AND_GAP, "x"), F.lit(SEPARATORS))
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """Adds number, weight and target to rows (source, source_size).

    The level at which weight * level, cut at most * source_size, sums to all
    words is found by Newton's steps on that piecewise linear sum: each is one
    aggregation, and each puts at least one more source at its limit.
    """
    # A key of its own for all rows: positions join by key and slice.
    whole = sources.withColumn("table", F.lit(0))
    ordered = number_rows(whole, ["table"], [F.col("source").asc_nulls_last()], "number").drop("table")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    table = materialize(
        ordered.withColumn("weight", F.element_at(turn, ((F.col("number") - 1) % len(weights) + 1).cast("int")))
    )
    limit = F.col("source_size") * most
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, settled = 0.0, None
    while True:
        # At level 0 no source with words is above its limit.
        full = (F.col("weight") * level >= limit) if settled is not None else F.col("source_size") == 0
        now = table.agg(
            F.count_if(full),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if now[0] == settled:
            break
        settled = now[0]
        if not now[2]:
            level = float("inf")
            break
        level = (total - now[1]) / now[2]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), limit).cast("double"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _pivot(draw: Column):
    """One pair: the carried document and the next one; `draw` is seeded by the group."""

    def settle(state: Column, item: Column) -> Column:
        carried = state["carried"]
        into = F.least(carried["size"] - carried["mass"], item["mass"])
        out = F.least(carried["mass"], item["size"] - item["mass"])
        gains = _uniform(draw, F.size(state["done"])) * (into + out) < out
        first = F.when(gains, carried["size"] - carried["mass"] <= item["mass"]).otherwise(
            carried["mass"] <= item["size"] - item["mass"]
        )
        facts = F.array(F.struct(gains.alias("gains"), first.alias("first")))
        return F.when(
            carried.isNull(), F.struct(state["done"].alias("done"), item.alias("carried"))
        ).otherwise(F.transform(facts, lambda f: _after(state, item, f["first"], f["gains"] == f["first"]))[0])

    return settle


def _after(state: Column, item: Column, first: Column, taken: Column) -> Column:
    """The carried one (first) or the item is settled as taken or not; the other carries on."""
    carried = state["carried"]
    gone = F.when(first, carried).otherwise(item)
    stays = F.when(first, item).otherwise(carried)
    mass = carried["mass"] + item["mass"] - F.when(taken, gone["size"]).otherwise(0)
    left = F.greatest(F.lit(0.0), F.least(mass, stays["size"].cast("double")))
    row = F.struct(gone["doc_id"].alias("doc_id"), gone["size"].alias("size"), taken.cast("int").alias("up"))
    return F.struct(
        F.array_append(state["done"], row).alias("done"), stays.withField("mass", left).alias("carried")
    )


def _sweep(groups: DataFrame, level: int, seed: int) -> DataFrame:
    """groups: number, bucket, items. Adds `swept`: the settled documents and the unsettled one."""
    item = groups.schema["items"].dataType.elementType
    done = f"array<struct<doc_id:{item['doc_id'].dataType.simpleString()},size:bigint,up:int>>"
    start = F.struct(
        F.array().cast(done).alias("done"), F.lit(None).cast(item.simpleString()).alias("carried")
    )
    draw = F.xxhash64(F.lit(seed), F.lit(level), F.col("number"), F.col("bucket"))
    return groups.select(
        "number", "bucket", F.aggregate("items", start, _pivot(draw)).alias("swept")
    )


def plan_copies(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0, seed: int = SEED
) -> DataFrame:
    """How often every document is taken so that each source has its share of all words.

    Sources in code-point order, null last, have `weights` in turn; a target
    stops at `most` times its source's words.  Returns doc_id, source, size,
    source_size, target, copies, taken (copies * size).
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"))
    alike = materialize(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")))
    sources = alike.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("rows")).otherwise(0)).alias("worded"),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = materialize(
        source_targets(sources, weights, most)
        .withColumn("whole", F.floor(rate).cast("long"))
        .withColumn("fraction", rate - F.floor(rate))
        .withColumn("buckets", F.ceil(F.col("worded") / GROUP))
    )
    same = alike["source"].eqNullSafe(targets["source"])
    dealt = alike.join(targets, same).select("number", "doc_id", "size", "rows", "fraction", "buckets")
    rounds = (F.col("size") > 0) & (F.col("fraction") > 0)
    plain = dealt.where(~rounds).select(
        "number", "doc_id", "size", F.lit(0).alias("up"), F.explode(F.sequence(F.lit(1), F.col("rows")))
    )
    # Rows that are alike go in parts of at most GROUP to buckets of their own.
    parts = dealt.where(rounds).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / GROUP)))
    )
    fill = F.least(F.lit(GROUP), F.col("rows") - F.col("part") * GROUP).cast("int")
    item = F.struct("size", "doc_id", "part", (F.col("size") * F.col("fraction")).alias("mass"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "part"), F.col("buckets"))
    groups = (
        parts.groupBy("number", bucket.alias("bucket"))
        .agg(F.sort_array(F.collect_list(F.struct(*_sort_key(), item.alias("item"), fill.alias("fill"))), asc=False).alias("g"))
        .select("number", "bucket", F.flatten(F.transform("g", lambda g: F.array_repeat(g["item"], g["fill"]))).alias("items"))
    )
    settled = [plain.drop("col")]
    most_buckets = targets.agg(F.coalesce(F.max("buckets"), F.lit(0))).first()[0]
    level = 0
    while True:
        swept = materialize(_sweep(groups, level, seed))
        settled.append(swept.select("number", F.explode("swept.done").alias("d")).select("number", "d.*"))
        left = swept.select("number", "bucket", F.col("swept.carried").alias("item"))
        if most_buckets <= 1:
            break
        most_buckets, level = -(-most_buckets // GROUP), level + 1
        groups = (
            left.groupBy("number", F.floor(F.col("bucket") / GROUP).alias("bucket"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("item.size"), F.col("bucket").alias("from"), "item")), asc=False).alias("g"))
            .select("number", "bucket", F.transform("g", lambda g: g["item"]).alias("items"))
        )
    up = F.col("item.mass") * 2 > F.col("item.size")
    settled.append(left.select("number", "item.doc_id", "item.size", up.cast("int").alias("up")))
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    copies = F.col("whole") + F.col("up")
    return rows.join(targets, "number").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"),
        F.when(F.col("size") > 0, copies * F.col("size")).otherwise(0).alias("taken"),
    )


def _sort_key() -> list[Column]:
    return [F.col("size").alias("_size"), F.col("doc_id").alias("_id"), F.col("part").alias("_part")]
