"""First-wins claims on a key, kept in the state store of a stream.

The state of a key is the package that took it.  A batch reads and writes only
the keys it brings, so its cost follows the batch and not the history, and a
batch that is run again starts from the state before it and flags the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Claims(StatefulProcessor):
    """Flags every row but the first of a key; inside a batch the least package id is first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._holder = handle.getValueState("holder", "package_id STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self._holder.exists()
        first: pd.DataFrame | None = None  # the only row held back, however many a key has
        for frame in rows:
            if not taken:
                frame = pd.concat([f for f in (first, frame) if f is not None]).reset_index(drop=True)
                best = frame["package_id"].fillna("").argmin()
                first, frame = frame.iloc[[best]], frame.drop(index=best)
            yield frame.assign(duplicate=True)
        if first is not None:
            self._holder.update((first["package_id"].iloc[0],))
            yield first.assign(duplicate=False)

    def close(self) -> None:
        pass


def claim(packages: DataFrame, key: str) -> DataFrame:
    """The rows of a stream (key, package_id, ...) with `duplicate`."""
    return packages.groupBy(key).transformWithStateInPandas(
        _Claims(), StructType([*packages.schema.fields, StructField("duplicate", BooleanType())]), "Append", "None"
    )


@contextmanager
def large_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, off the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
