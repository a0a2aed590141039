"""JSON documents as rows of paths, and documents compared path by path."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.session import materialize

PLAIN_NAME = "^[A-Za-z_][A-Za-z0-9_]*$"


def _step(key: Column, pos: Column) -> Column:
    """A member as `.name`, or `["na.me"]` if the name is not plain; an element as `[3]`."""
    member = F.when(F.regexp_like(key, F.lit(PLAIN_NAME)), F.concat(F.lit("."), key)).otherwise(
        F.to_json(F.array(key))
    )
    return F.when(key.isNull(), F.concat(F.lit("["), pos.cast("string"), F.lit("]"))).otherwise(member)


def _kind(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "VOID", "null")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .otherwise("number")
    )


def document_nodes(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, path, kind, value) for every node of the JSON documents in `text`.

    The root is `$`; kind is object, array, string, number, boolean or null, and
    invalid for a text that is no JSON; value is the node as compact JSON with
    sorted members.  The nodes of one depth are opened in one job, and written,
    so a document is parsed once and every node is met once, however deep.
    """
    document = F.try_parse_json(text)
    level = df.select(*keys, F.lit("$").alias("path"), document.alias("node"))
    done: list[DataFrame] = []
    while True:
        kind = F.when(F.col("node").isNull(), "invalid").otherwise(_kind(F.col("node")))
        level = materialize(level.withColumn("kind", kind))
        if level.isEmpty():
            break
        done.append(level.select(*keys, "path", "kind", F.to_json("node").alias("value")))
        inside = level.where("kind IN ('object', 'array')")
        opened = inside.lateralJoin(
            df.sparkSession.tvf.variant_explode(F.col("node").outer())
        )
        level = opened.select(
            *keys, F.concat("path", _step(F.col("key"), F.col("pos"))).alias("path"), F.col("value").alias("node")
        )
    if not done:
        return level.select(*keys, "path", "kind", F.lit(None).cast("string").alias("value"))
    return reduce(DataFrame.unionByName, done)


def document_leaves(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The nodes without anything below them: scalars, and empty objects and arrays."""
    nodes = document_nodes(df, keys, text)
    return nodes.where("kind NOT IN ('object', 'array') OR value IN ('{}', '[]')")


def compare_documents(
    left: DataFrame, right: DataFrame, keys: Sequence[str], text: str
) -> DataFrame:
    """Leaves in which two documents with equal keys differ: (keys, path, problem, left, right).

    Keys tell a document.  problem is `changed`, `missing` (only in left) or
    `unexpected` (only in right); a number is equal to another by its value, so
    1 and 1.0 do not differ.  A document that one side lacks differs in all its
    leaves.  The join is by (keys, path), so no document meets another.
    """
    number = F.when(F.col("kind") == "number", F.col("value").cast("double"))
    side = lambda df, name: document_leaves(df, keys, text).select(
        *keys, "path", F.struct("kind", "value", number.alias("number")).alias(name)
    )
    both = side(left, "a").join(side(right, "b"), [*keys, "path"], "full_outer")
    a, b = F.col("a"), F.col("b")
    same = (a["kind"] == b["kind"]) & F.when(
        a["number"].isNotNull() & b["number"].isNotNull(), a["number"] == b["number"]
    ).otherwise(a["value"] == b["value"])
    problem = (
        F.when(b.isNull(), "missing").when(a.isNull(), "unexpected").when(~same, "changed")
    )
    return both.select(
        *keys, "path", problem.alias("problem"), a["value"].alias("left"), b["value"].alias("right")
    ).where(F.col("problem").isNotNull())
