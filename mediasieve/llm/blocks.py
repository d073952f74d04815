"""Blocks of documents, and packed key lists that blocks exchange through Spark shuffles.

Jobs that need a fact about every n-gram of a corpus (how often, where first)
would shuffle one row for each n-gram and document, and again for the answer.
Here the documents are dealt into blocks of bounded size. A block sends each
distinct key once, as sorted key lists cut by key range; the task of a key
range answers with one array for each list, in the list's order. So a key that
a third of all documents share costs one entry a block, and no group is larger
than its key range's share of the distinct keys of all blocks.

Blocks and ranges have fixed sizes, so a task's memory doesn't grow with the
corpus. Only lists with keys are sent: there are never more of them than keys
of blocks, which are at most the n-grams of the corpus.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BLOCK_BYTES = 8e6
RANGE_KEYS = 2e6


def key_bits(n_keys: int) -> int:
    """Bits of a key: with 24 more than the number of keys needs, one key in 16 million meets another's at any size."""
    return min(64, max(n_keys, 1).bit_length() + 24)


def block_of(n_blocks: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(n_blocks)).cast("int")


def sizes(n_bytes: int, n_keys: int, block_bytes: float = BLOCK_BYTES) -> tuple[int, int]:
    """Numbers of blocks and of key ranges (a power of two), so that a block and a range take as much memory in any corpus."""
    return max(1, math.ceil(n_bytes / block_bytes)), 1 << max(0, math.ceil(math.log2(max(n_keys, 1) / RANGE_KEYS)))


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, as many as the largest needs; planes compress well."""
    values = values.astype("<u8")
    wide = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([wide]) + values.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    wide = data[0]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :wide] = np.frombuffer(data, np.uint8, offset=1).reshape(wide, n).T
    return planes.reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=np.uint64)


def cuts(keys: np.ndarray, n_ranges: int, bits: int) -> np.ndarray:
    """Where each of the key ranges begins and ends in sorted keys of so many bits."""
    if n_ranges == 1:
        return np.array([0, len(keys)])
    edges = np.arange(1, n_ranges, dtype=np.uint64) << np.uint64(bits - int(math.log2(n_ranges)))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def texts_of(table: pa.Table | pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 byte strings, null as empty."""
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""
    row = docs.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    return int(row[0] or 0), int(row[1] or 0)
