"""What Python workers hold between tasks.

Spark reuses workers, and a worker's allocators keep what a task has freed. Operators therefore give
memory back when a task or a block is done, take batches of a bounded size, and keep at most one model
or tokenizer in a worker: the one that was used last.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

_kept: dict[tuple, object] = {}


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's own function, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, once for a worker until something else is asked for."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def tidy(run: Callable) -> Callable:
    """A function of an iterator of batches that gives memory back when the task is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a table, after each."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return wrapped


def tidy_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two tables."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return wrapped


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, jobs hand Python batches of a few megabytes, unless the session sets a size of its own."""
    own = spark.conf.get(BATCH, None) is None
    if own:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(BATCH)
