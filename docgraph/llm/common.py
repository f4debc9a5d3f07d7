"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import written

BATCH_ROWS = 1000  #: rows of an Arrow batch: documents are long
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows for this session, so that tasks hold less of long texts, unless it asks for a number of its own."""
    if spark.conf.get(_BATCH) == "10000":  # Spark's default
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder, written in small batches."""
    small_batches(df.sparkSession)
    return written(df, name)


def release() -> None:
    """Give memory that is free back to the system, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(work: Callable) -> Callable:
    """``work`` (on batches, or on a group's table), after which its memory is given back."""

    @functools.wraps(work)
    def run(x):
        out = work(x)
        if isinstance(out, pa.Table):
            release()
            return out
        return _then_release(out)

    return run


def _then_release(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        release()


def packed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, kind, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size * np.dtype(kind).itemsize, "zstd"), kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose labels no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def by_bytes(texts: list, limit: int):
    """Slices (start, end) of a list of strings or None, each of about ``limit`` characters at most or one text."""
    start = used = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if used and used + n > limit:
            yield start, i
            start, used = i, 0
        used += n
    if start < len(texts):
        yield start, len(texts)
