"""Helpers for functions that get Arrow batches from ``mapInArrow``."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNSET = "67108864b"  # Spark's own default
_SMALLER = "8m"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but lies at the same path.

    Rows come to them in batches of some megabytes, unless the session says otherwise: texts may be long.
    """
    if spark.conf.get(_BATCH, _UNSET) == _UNSET:
        spark.conf.set(_BATCH, _SMALLER)
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *known])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``; a longer text stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, done + most, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
        pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch, null as empty."""
    return pc.fill_null(batch.column(column), "")


def split(strings: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array]:
    """Non-empty parts of every string, and where in them each string's parts begin (one more than strings)."""
    lists = pc.split_pattern_regex(strings, pattern)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    return before[offsets - offsets[0]], values.filter(pa.array(full))


def code_points(strings: list[str], separator: str) -> np.ndarray:
    """All strings as code points, with the separator before, between and after them."""
    joined = separator + separator.join(strings) + separator
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
