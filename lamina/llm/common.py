"""What the training-data operators share: table access, shared storage and text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.ordering import small_batches, written

#: Rows that a Python step turns into one output batch; bounds its memory with long texts.
SLICE_ROWS = 512
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(docs: DataFrame) -> DataFrame:
    """docs, after the session's Arrow batches are cut to BATCH_ROWS rows: a Python step holds two of them, on
    either side of the pipe, and their rows are whole texts. Smaller settings stay."""
    small_batches(docs.sparkSession)
    return docs


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: its lineage is cut, lost executors don't
    repeat the work before it, and its size is known to the planner."""
    return written(bounded_batches(df), name)


def broadcast_below(df: DataFrame, most: int) -> DataFrame:
    """A broadcast hint for a stored table of at most that many rows; a larger one joins by a shuffle.
    The count reads at most most + 1 rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def utf8(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to SLICE_ROWS rows and about SLICE_BYTES bytes each. After each batch Arrow's pool gives
    back what it holds beyond its use: workers live on for other stages."""
    pool = pa.default_memory_pool()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = max(1, min(SLICE_ROWS, int(n * SLICE_BYTES / max(1, batch.nbytes))))
        for at in range(0, n, rows):
            yield batch.slice(at, rows)
        pool.release_unused()


def binary_of(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary()).cast(pa.binary())
