"""What the operators need of a session: the package on the workers, and small batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from gleanery.session import attach as attach_package

#: Rows of a batch sent to Python at once, unless the session names a number of its own. Texts are long.
BATCH_ROWS = 2_000
DEFAULT_ROWS = "10000"
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def attach(spark: SparkSession) -> SparkSession:
    if spark.conf.get(SETTING, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(SETTING, str(BATCH_ROWS))
    return attach_package(spark)


def give_back() -> None:
    """Return freed memory to the machine: a Python worker lives on after a task, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, giving memory back when the task is done."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied
