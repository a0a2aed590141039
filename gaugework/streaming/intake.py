"""Incremental intake and live ranking as Structured Streaming jobs.

Every micro-batch claims the digests of its packages in the state store, runs
the batch plan on the packages, and appends four tables below one folder:

  decisions/      one row per package, rejected ones included, by batch
  contributions/  passing metric values of accepted packages, by batch
  runs/           the same values as (cell, contributor, value, count) in hash buckets
  cells/          new values of the comparison cells the batch touched, in hash buckets

No batch reads the history: duplicates come from keyed state, and the cells it
touched from the buckets they lie in.  A replayed batch overwrites exactly its
own partitions and ignores what an earlier attempt of the same batch left
behind, so the job is idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugework.operators import cells as cell_ops
from gaugework.operators.ordered import last_rows
from gaugework.plans import evidence_ranking as ranking
from gaugework.session import materialize
from gaugework.streaming.bucketed_log import BucketedLog
from gaugework.streaming.first_wins import claim, large_state

PACKAGE_SCHEMA = (
    "package_id STRING, submission BINARY, result BINARY, file_set_valid BOOLEAN, author STRING"
)
DECISION_COLUMNS = (
    "package_id STRING, result_sha256 STRING, submission_sha256 STRING, submission_id STRING, "
    "result_id STRING, workload_id STRING, contributor STRING, report_id STRING, "
    "classification STRING, reason_codes ARRAY<STRING>, behaviour STRING, "
    "behaviour_reasons ARRAY<STRING>, recommendation STRING, "
    "metrics ARRAY<STRUCT<metric_id:STRING,status:STRING,reason_codes:ARRAY<STRING>,value:DOUBLE>>, "
    "identity_json STRING"
)
CONTRIBUTION_COLUMNS = (
    "package_id STRING, result_sha256 STRING, workload_id STRING, contributor STRING, "
    "contributor_key STRING, comparison_id STRING, metric_id STRING, value DOUBLE"
)
CELL = ["comparison_id", "workload_id", "metric_id"]
RUN_COLUMNS = (
    "comparison_id STRING, workload_id STRING, metric_id STRING, contributor_key STRING, "
    "value DOUBLE, runs BIGINT"
)
CELL_COLUMNS = (
    "comparison_id STRING, workload_id STRING, metric_id STRING, value DOUBLE, "
    "contributors BIGINT, runs BIGINT"
)


def read_package_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Packages as they are landed in parquet files, with the file each row came in."""
    landed = spark.readStream.schema(PACKAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return landed.parquet(folder).select("*", F.col("_metadata.file_path").alias("landed"))


def _table(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    path = f"{folder}/{name}"
    schema = f"{columns}, batch_id BIGINT"
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = exists.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(exists):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "decisions", DECISION_COLUMNS)


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "contributions", CONTRIBUTION_COLUMNS)


def _write(df: DataFrame, folder: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")


def run_log(spark: SparkSession, folder: str) -> BucketedLog:
    return BucketedLog(spark, f"{folder}/runs", RUN_COLUMNS, CELL)


def cell_log(spark: SparkSession, folder: str) -> BucketedLog:
    return BucketedLog(spark, f"{folder}/cells", CELL_COLUMNS, CELL)


def as_runs(rows: DataFrame, count: Column | None = None) -> DataFrame:
    """Equal values of a contributor in a cell as one row with their number."""
    number = F.count("*") if count is None else F.sum(count)
    return rows.groupBy(*CELL, "contributor_key", "value").agg(number.alias("runs"))


def touched_cells(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Exact values of the cells a batch touched, from the buckets these cells lie in.

    Medians do not merge, but runs of (value, count) do: a touched cell is
    computed from its runs, and buckets without a touched cell are not opened.
    """
    log = run_log(spark, folder)
    new = log.read(batch_id).where(F.col("batch_id") == batch_id).select(*CELL).distinct()
    rows = log.read(batch_id, log.touched(new)).join(new, CELL, "left_semi")
    medians = cell_ops.contributor_medians(
        as_runs(rows, F.col("runs")), CELL, "contributor_key", "value", "runs"
    )
    return cell_ops.weighted_cells(medians, CELL)


def refresh_cells(contributed: DataFrame, batch_id: int, folder: str) -> None:
    """Adds a batch of contributions to the live ranking."""
    spark = contributed.sparkSession
    run_log(spark, folder).append(as_runs(contributed), batch_id)
    cell_log(spark, folder).append(touched_cells(spark, folder, batch_id), batch_id)


def compact(spark: SparkSession, folder: str, through: int) -> None:
    """Merges the buckets' batches up to `through`; runs between batches, readers see either form."""
    run_log(spark, folder).compact(through, lambda rows: as_runs(rows, F.col("runs")))
    cell_log(spark, folder).compact(
        through, lambda rows: last_rows(rows, CELL, ["batch_id"]).drop("batch_id")
    )


def process_batch(
    batch: DataFrame,
    batch_id: int,
    models: DataFrame,
    trusted: ranking.Trusted,
    folder: str,
    claims: DataFrame | None = None,
) -> None:
    """Decides a batch of packages and adds it to the tables.

    claims: package_id, duplicate from the stream's state.  Without them (a
    batch run by hand) digests of every earlier package block this batch; its
    own earlier try does not.
    """
    spark = batch.sparkSession
    if claims is None:
        earlier = decisions(spark, folder).where(F.col("batch_id") < batch_id)
        decided = ranking.decide(batch, models, trusted, earlier.select("result_sha256"))
    else:
        repeated = claims.where("duplicate").select("package_id").distinct()
        decided = ranking.decide(batch, models, trusted, repeated=repeated)
    _write(decided, folder, "decisions", batch_id)
    mine = spark.read.schema(DECISION_COLUMNS).parquet(f"{folder}/decisions/batch_id={batch_id}")
    _write(ranking.contributions(mine), folder, "contributions", batch_id)
    new = spark.read.schema(CONTRIBUTION_COLUMNS).parquet(f"{folder}/contributions/batch_id={batch_id}")
    refresh_cells(new, batch_id, folder)


def start_intake(
    packages: DataFrame, models: DataFrame, trusted: ranking.Trusted, folder: str
) -> StreamingQuery:
    """Start the intake over a stream of packages from `read_package_stream`.

    Only (digest, package_id, file) goes through the state; the documents of a
    batch are read again from its own files.
    """
    spark = packages.sparkSession
    digest = F.sha2(F.coalesce("result", F.lit("").cast("binary")), 256)
    claimed = claim(packages.select(digest.alias("result_sha256"), "package_id", "landed"), "result_sha256")

    def run(claims: DataFrame, batch_id: int) -> None:
        session = claims.sparkSession
        kept = materialize(claims)
        files = [r.landed for r in kept.select("landed").distinct().collect()]
        if files:
            documents = session.read.schema(PACKAGE_SCHEMA).parquet(*sorted(files))
            process_batch(documents, batch_id, models, trusted, folder, kept)

    with large_state(spark):
        return (
            claimed.writeStream.foreachBatch(run)
            .option("checkpointLocation", f"{folder}/_progress")
            .trigger(availableNow=True)
            .start()
        )


def live_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Current views: the latest value of every cell, ranked per view."""
    current = last_rows(cell_log(spark, folder).read(), CELL, ["batch_id"])
    return ranking.rank_views(current)
