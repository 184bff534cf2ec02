"""Helpers shared by the training-data operators: query registration, durable cuts, byte-level text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilake.session import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over a scale folder, with the SQL that must give the same rows if there is one."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def forget(frame: DataFrame | None) -> None:
    """Delete the files of a :func:`durable` table that nothing reads any more."""
    if frame is None:
        return
    spark = frame.sparkSession
    files = frame.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column_values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def int64(values) -> pa.Array:
    """Arrow column of longs from any 64-bit array; unsigned hashes keep their bits."""
    return pa.array(np.asarray(values).astype(np.uint64, copy=False).view(np.int64) if np.asarray(values).dtype == np.uint64 else np.asarray(values, dtype=np.int64))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a bijection)."""
    v = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
    return v


def same(left: Column, right: Column) -> Column:
    """Equality that also matches two missing keys."""
    return left.eqNullSafe(right)


def of_batches(rows: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A ``mapInArrow`` function from one that turns a batch into a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := rows(batch)) is not None:
                yield out

    return run


__all__ = ["QUERIES", "SQL", "column_values", "durable", "forget", "int64", "mix", "of_batches", "query", "same", "table", "F"]
