"""Shared helpers of the text operators: bounded slices of Arrow batches, mixing functions, row ids."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that one vectorised step of a Python worker handles (a longer document stands alone).
SLICE_BYTES = 1 << 20
#: Rows of text that Spark hands to a Python worker at once (its default of 10,000 would hold far more memory).
BATCH_ROWS = 1000
#: What separates words wherever a contract says ``[^\x20\x09-\x0D]+``: exactly what bytes.split() splits at.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no further column of the input can clash with ours.  Batches for Python
    workers are cut to ``BATCH_ROWS`` rows, by a setting of the session (Spark reads it when the plan runs), if they are
    larger there."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) > BATCH_ROWS or int(conf.get(name)) <= 0:
        conf.set(name, str(BATCH_ROWS))
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)


def id_field(rows: DataFrame, column: str = "doc_id") -> tuple[str, pa.DataType]:
    """The type of an id column (any that Arrow knows: string, short, int, long, decimal, binary ...) in Spark's and in
    Arrow's words, for the schemas that our functions return."""
    kind = rows.schema[column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece holds about ``limit`` bytes in ``column`` at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - size) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Gives memory that a finished task no longer uses back to the system (workers live on for later tasks)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * u64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * u64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
