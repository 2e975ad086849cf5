"""Bounded memory in Python workers, which Spark reuses over tasks and stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch at most; texts are long, and both sides hold a batch in memory.
BATCH_ROWS = 1024
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch at most, unless one row has more.
BATCH_BYTES = 32 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_HELD: dict[Hashable, Any] = {}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` and ``BATCH_BYTES``, if it is larger."""
    now = int(spark.conf.get(_BATCH_SETTING))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Drop what an earlier task left, and give free memory back to the system."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def resource(key: Hashable, make: Callable[[], Any]) -> Any:
    """An object that is costly to make: the worker keeps the last one only."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]
