"""Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of the batches that Spark hands to Python.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: a number of bytes with or without a unit (64m, 1g, 262144b)."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", size.lower())
    if not m:
        raise ValueError(f"not a size: {size}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


def bound_batches(spark: SparkSession) -> None:
    """Lets the session hand batches of BATCH_BYTES at most to Python, if its limit is higher or none: rows of texts differ a thousandfold in size."""
    limit = _bytes(spark.conf.get(_LIMIT))
    if not 0 < limit <= BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that Arrow and the C library hold but don't use; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts are Python objects at a time; unused memory is given back at the end."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()
