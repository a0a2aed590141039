"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the least node.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its least neighbour, then its smaller ones.  Both end in a
    star around the least node after a number of rounds that is logarithmic in
    the number of nodes.  A round is an aggregation with partial sums and an
    equi-join that the optimizer may split, so the hub of a large star is not
    gathered anywhere; each round is written to the shared folder, which cuts
    the lineage.  Self links and repeated links are allowed; null ends are
    ignored.
    """
    edges = materialize(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _state(edges)
    while before[0]:
        edges = materialize(_small_star(_large_star(edges)))
        after = _state(edges)
        if after == before:
            break
        before = after
    hubs = edges.groupBy("v").agg(F.lit(None)).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)


def _state(edges: DataFrame) -> tuple:
    """Number of links and two sums that change with them."""
    mixed = F.xxhash64("u", "v")
    return tuple(
        edges.agg(
            F.count("*"),
            F.coalesce(F.sum(mixed.cast("decimal(20,0)")), F.lit(0)),
            F.coalesce(F.bit_xor(mixed), F.lit(0)),
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and all its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
