"""Whole-batch text helpers: many documents of an Arrow column at once as NumPy arrays.

Texts are UTF-8 bytes in one buffer with row offsets. Null texts are empty texts. Batches are
worked on in pieces of about a megabyte, so memory is bounded by the piece or by one text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(
    column: pa.Array, limit: int = PIECE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes, in order."""
    data, offs = utf8(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        end = min(end, rows)
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(
    data: np.ndarray, offs: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of runs of bytes in a class.

    `inside` is a table of 256 booleans. A run never crosses a row border.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    within = inside[data]
    border = np.zeros(n + 1, bool)
    border[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = within[:-1]
    starts = np.flatnonzero(within & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = within[1:]
    ends = np.flatnonzero(within & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def strings(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The stretches between neighbouring cuts as an Arrow array, without copying."""
    buffer = pa.py_buffer(np.ascontiguousarray(data))
    cuts = np.ascontiguousarray(cuts, dtype=np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), buffer]
    )


def gather(values: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated stretches values[first[i] : first[i] + counts[i]]."""
    total = int(counts.sum())
    if total == 0:
        return values[:0]
    where = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(total)
    return values[where]


#: odd multiplier of the rolling hash and its inverse modulo 2**64: fixed values
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any stretches of one byte buffer in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = powers(BASE_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


#: rows of whole texts that travel together to a Python worker
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch: both ends hold a whole batch of texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: str, divisor: int):
    """crc32 of a column as text, modulo the divisor; null for null."""
    return F.crc32(F.col(column).cast("string")) % divisor


def give_back() -> None:
    """Freed memory goes back to the system; glibc and Arrow keep a good part of it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow whose worker holds no freed memory when its task is over.

    Workers outlive their tasks and wait with what they hold, beside those that work.
    """

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def remembered(key: tuple, make: Callable[[], Any]) -> Any:
    """One object per Python worker, kept across its tasks (functions arrive anew with each)."""
    name = "tracewell_worker_objects"
    store = sys.modules.setdefault(name, ModuleType(name)).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
