"""Shared helpers for operators that see texts in Arrow batches: small batches, and one model a worker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and its Python workers; the default of 10,000 rows is hundreds of MB of long texts.
BATCH_BYTES = "4m"
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_HELD: dict[Any, Any] = {}


def bound_batches(spark: SparkSession) -> None:
    """Lets a session send its Python workers batches of ``BATCH_BYTES``, unless it names a size itself (results don't depend on it)."""
    if spark.conf.get(_BATCH_SETTING, None) in (None, spark.conf.get(_BATCH_SETTING)) and _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def release() -> None:
    """Drop the model that this worker holds, and give its memory back to the system."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The model ``key`` of this worker, made once; a worker that is used for another model forgets the last one first."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``size`` bytes of a column's texts, at least one text each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths + 16), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size)))
        yield batch.slice(at, to - at)
        at = to


def runs(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(slice of the batch, its texts) in runs of about ``size`` bytes, at least one text each; a null text is an empty one."""
    for part in slices(batch, column, size):
        yield part, [t or "" for t in part.column(column).to_pylist()]
