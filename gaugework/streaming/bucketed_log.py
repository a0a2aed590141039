"""An append-only table in hash buckets, read by bucket and compacted by generation.

  log/bucket=k/batch_id=b/     rows of batch b whose key falls into bucket k
  base/through=b/bucket=k/     all rows up to batch b, merged

A batch writes its own partitions and a replay overwrites them.  A reader takes
the newest complete base and the younger log partitions, of the buckets it names
alone: other folders are neither listed nor opened.  A base counts from the
moment its `_SUCCESS` file is there, so a compaction that fails is never seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


class BucketedLog:
    """Rows with `columns`; equal `keys` share a bucket."""

    def __init__(
        self, spark: SparkSession, folder: str, columns: str, keys: Sequence[str], buckets: int = BUCKETS
    ):
        self._spark, self._folder, self._columns = spark, folder, columns
        self._keys, self._buckets = list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self._keys), F.lit(self._buckets)).cast("int")

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Writes a batch; within a bucket rows are sorted by key and value."""
        placed = rows.withColumn("bucket", self.bucket()).withColumn("batch_id", F.lit(batch_id).cast("long"))
        self._sorted(placed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "batch_id"
        ).parquet(f"{self._folder}/log")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most as many numbers as there are buckets."""
        found = rows.select(self.bucket().alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    def read(self, upto: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of the named buckets (all by default) up to a batch, with the batch they come from.

        Rows of a base carry the number of the batch it goes through.
        """
        through = self.compacted(upto)
        log = self._parts(f"{self._folder}/log", buckets, "bucket INT, batch_id LONG")
        log = log.where(F.col("batch_id") > through) if through is not None else log
        log = log.where(F.col("batch_id") <= upto) if upto is not None else log
        if through is None:
            return log.drop("bucket")
        base = self._parts(f"{self._folder}/base/through={through}", buckets, "bucket INT")
        return log.unionByName(base.withColumn("batch_id", F.lit(through).cast("long"))).drop("bucket")

    def compacted(self, upto: int | None = None) -> int | None:
        """Batch that the newest complete base goes through, at most `upto`."""
        done = [int(n.removeprefix("through=")) for n in self._children(f"{self._folder}/base", "_SUCCESS")]
        return max((n for n in done if upto is None or n <= upto), default=None)

    def compact(self, through: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Merges everything up to a batch into one base; `merge` gets the rows and returns `columns`.

        Log partitions the base covers are no longer read and may be deleted,
        as may older bases.
        """
        merged = merge(self.read(through)).withColumn("bucket", self.bucket())
        self._sorted(merged).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self._folder}/base/through={through}"
        )

    def _sorted(self, rows: DataFrame) -> DataFrame:
        order = [c for c in rows.columns if c not in ("bucket", "batch_id")]
        ahead = [*self._keys, *[c for c in order if c not in self._keys]]
        return rows.repartition("bucket").sortWithinPartitions("bucket", *ahead)

    def _parts(self, root: str, buckets: Iterable[int] | None, partitions: str) -> DataFrame:
        wanted = None if buckets is None else {f"bucket={b}" for b in buckets}
        there = [n for n in self._children(root) if n.startswith("bucket=") and (wanted is None or n in wanted)]
        schema = f"{self._columns}, {partitions}"
        if not there:
            return self._spark.createDataFrame([], schema)
        reader = self._spark.read.schema(schema).option("basePath", root)
        return reader.parquet(*[f"{root}/{name}" for name in sorted(there)])

    def _children(self, folder: str, holding: str | None = None) -> list[str]:
        """Names in a folder; with `holding`, those that hold such a file."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path
        top = path(folder)
        system = top.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not system.exists(top):
            return []
        names = [s.getPath().getName() for s in system.listStatus(top)]
        return [n for n in names if holding is None or system.exists(path(f"{folder}/{n}/{holding}"))]
