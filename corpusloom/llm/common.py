"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialise, number_rows, ship_package

__all__ = ["free_name", "held", "let_go", "map_batches", "materialise", "mix64", "number_rows", "row_chunks", "sums_by_row", "text_bytes", "trim", "with_names"]

#: Bytes of text that one vectorised step works on; bounds the numpy temporaries of a task.
CHUNK_BYTES = 1 << 19


#: What this worker process keeps from task to task (one encoder with its cache).
_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """The object of that name, made once for each worker process; another one takes its place."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def trim() -> None:
    """Give freed memory back to the system: workers live on after their tasks, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let_go() -> None:
    """Drop what another operator's task has kept in this worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        trim()


def with_names(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns cannot clash."""
    ship_package(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has (Spark does not tell capitals from small letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 2000) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows, which bounds what a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield fn(batch.slice(start, rows))
        trim()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (one more entry than rows); null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    if data is None or not len(wide):
        return np.zeros(0, np.uint8), np.zeros(len(wide) + 1, np.int64)
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``size`` bytes; a longer row is a range of its own."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums_by_row(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[starts[i]:ends[i]]``; an empty range sums to 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[starts]
