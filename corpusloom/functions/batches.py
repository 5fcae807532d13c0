"""Memory of Python workers: bytes of an Arrow batch, and what a task leaves behind."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows in an Arrow batch; one row at least.
BATCH_BYTES = 8 << 20


def bound_bytes(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """At most ``most`` bytes in an Arrow batch; rows that hold a block of vectors would fill the default many times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not 0 < int(now.rstrip("b") if now.rstrip("b").isdigit() else most + 1) <= most:
        spark.conf.set(name, str(most))


def lean(run):
    """``run`` over batches, giving freed memory back to the system at its end: workers outlive their tasks."""

    @functools.wraps(run)
    def work(it):
        yield from run(it)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return work
