"""Arrow batches of a bounded size, and Python workers that give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes in an Arrow batch (a longer row is a batch of its own). Texts are long: with Spark's defaults of 10,000
#: rows and no bound of bytes a batch takes up to hundreds of MB in the JVM and again in Python, in every task.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20


def settle(spark: SparkSession) -> None:
    """Set the size of Arrow batches for long texts, unless the session has sizes of its own."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))
    if int(spark.conf.get(size, str((1 << 31) - 1)).rstrip("b")) >= (1 << 31) - 1:
        spark.conf.set(size, str(ARROW_BYTES))


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL(None)
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def let_go() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and others share the executor's memory."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's function that lets memory go at its end."""

    @wraps(run)
    def done(*args):
        try:
            yield from run(*args)
        finally:
            let_go()

    return done
