"""Arrow plumbing shared by the operators that work on whole texts."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from gaugework.session import shared_folder

# Bytes of text handed to one call; a single longer text is a batch of its own.
BATCH_BYTES = 8 << 20

Columns = dict[str, Iterable]


def by_bytes(batch: pa.RecordBatch, text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts sum to about `limit` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(run)) + 1
    for start, end in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start)


def utf8(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    schema: str | StructType,
    make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], Columns]],
    limit: int = BATCH_BYTES,
) -> DataFrame:
    """Applies a function to runs of texts; the columns in `keep` come first, unchanged.

    `make` runs once in each task and returns the function, which gets the
    texts as UTF-8 (None for null) and returns one value a text for each column
    of `schema`.  Only `keep` and `text` are read, so further columns of the
    input can have any name.
    """
    added = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = df.select(*[df[c] for c in keep], df[text].cast("string").alias("__text"))
    out = StructType([rows.schema[c] for c in keep] + list(added.fields))
    width = len(keep)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in by_bytes(whole, width, limit):
                made = work(utf8(batch, width), batch)
                cells = [x if isinstance(x := made[n], pa.Array) else pa.array(x, k) for n, k in kinds]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in range(width)] + cells, names=[*keep, *(n for n, _ in kinds)]
                )

    return rows.mapInArrow(run, out)


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """One row a key, whichever has the least hash: the same one however rows are partitioned."""
    rest = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*rest), F.xxhash64(*rest))
    return rows.groupBy(key).agg(first.alias("__row")).select(key, "__row.*")


def materialize(df: DataFrame, compression: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Writes rows once to the folder all executors share and reads them back.

    `compression` is the Parquet codec, the session's by default;
    `rows_per_file` the most rows of a file, 0 for any number.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write
    (writer.option("compression", compression) if compression else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
