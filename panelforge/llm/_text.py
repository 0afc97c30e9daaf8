"""Arrow text columns as flat numpy buffers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deleting these from UTF-8 bytes deletes the characters [\x20\x09-\x0D]; no other character's bytes are below 0x80.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def tidy() -> None:
    """Gives freed memory back to the system at a task's end: idle workers keep what their allocators hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with ``tidy`` after its last batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return wrapped


def numbered(df: DataFrame, keep: list[str], *more: Column) -> tuple[DataFrame, list[str], list[str]]:
    """``keep`` and ``more`` of ``df`` with the former's names and new ones, c0 on: columns may have any names, which
    Arrow functions don't take all."""
    new = [f"c{k}" for k in range(len(keep))]
    return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, new, strict=True)], *more), list(keep), new


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array with empty texts in the place of nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def flat(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and where each row starts in them (one more entry than rows)."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return memoryview(b""), np.zeros(1, np.int64)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = memoryview(buffers[2] or b"")[at[0] : at[-1]]
    return data, at - at[0]


def pieces_of(batch: pa.RecordBatch, text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have about ``most_bytes`` together, one row at least."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = lengths[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(lengths, before + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def codepoints(data: memoryview | bytes) -> np.ndarray:
    """Code points of UTF-8 bytes, as uint32."""
    return np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """An array column from flat values and the start of each row."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32), pa.int32()), pa.array(values))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it (case aside, as Spark compares)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
