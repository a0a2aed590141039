"""Session set-up, the size of slices, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session setting: how many rows an ordered slice holds, about.
ROWS_PER_SLICE = "gaugework.rowsPerSlice"
DEFAULT_ROWS_PER_SLICE = 1_000_000


def build_session(name: str = "gaugework", cores: int | str = "*") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def rows_per_slice(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_SLICE, str(DEFAULT_ROWS_PER_SLICE)))


def slice_count(kept: DataFrame) -> int:
    """Number of ordered slices for rows that are already in a table, so counting them is cheap."""
    return max(1, -(-kept.count() // rows_per_slice(kept)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give an input with fewer partitions than cores to all of them before costly per-row work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only for a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once to a table in the shared folder and read them back.

    The plan is computed a single time, survives executor loss, keeps labels
    that a recomputation might choose differently, and later reads are
    columnar.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
