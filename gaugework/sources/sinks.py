"""Writers of the result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()
) -> None:
    """Parquet, one folder per partition value, rows sorted inside each file."""
    ordered = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_export(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Deterministic JSON lines: globally sorted, nulls kept."""
    df.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_quarantine(df: DataFrame, path: str) -> None:
    """Rejected and excluded rows with their reasons; nothing is dropped."""
    df.write.mode("overwrite").parquet(path)


def run_report(decided: DataFrame, status: str = "classification") -> DataFrame:
    """One row: how many came in, passed, wait for review, were rejected."""
    is_ = lambda s: F.count_if(F.col(status) == s)
    return decided.agg(
        F.count("*").alias("input"),
        is_("auto-accept").alias("accepted"),
        is_("manual-review").alias("manual_review"),
        is_("reject").alias("rejected"),
    )


def checksum_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of everything written below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256")
    )


def split_append(
    incoming: DataFrame, existing: DataFrame, key: str = "result_id", digest: str = "result_sha256"
) -> tuple[DataFrame, DataFrame]:
    """(new rows, collisions): same id and bytes is a no-op, other bytes a collision.

    An id that comes twice in one batch is appended once: the least digest
    stands for it, and any other digest is a collision.
    """
    known = existing.select(key, F.col(digest).alias("_stored")).distinct()
    rows = incoming.dropDuplicates([key, digest])
    first = rows.groupBy(key).agg(F.min(digest).alias("_first"))
    both = rows.join(first, key, "left").join(known, key, "left")
    holds = F.coalesce("_stored", "_first")
    fresh = both.where(F.col("_stored").isNull() & (holds == F.col(digest))).drop("_stored", "_first")
    clash = (
        both.where(holds != F.col(digest))
        .drop("_first")
        .withColumn("reason", F.lit("result-id-collision"))
    )
    return fresh, clash
