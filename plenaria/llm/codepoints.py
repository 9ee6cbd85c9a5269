"""Text columns as flat numpy arrays of code points.

A batch of Arrow strings is one UTF-8 buffer with offsets. It becomes one array of code points with row offsets and goes
back the same way; no Python string is made per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all rows one after another, and the n + 1 offsets of the rows in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        sizes = np.diff(at) * np.asarray(column.is_valid())
        if sizes.sum() != at[-1] - at[0]:
            return to_points(column.fill_null(""))
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) == len(raw):
        return points, at - at[0]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return points, starts[at - at[0]]


def to_strings(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The Arrow string column of points cut at offsets; rows that aren't valid are null."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    data = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    null = None
    if valid is not None and not valid.all():
        null = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets].tobytes()), pa.py_buffer(data), null).cast(pa.string())


def pieces(batch: pa.RecordBatch, column: int, most: int = 1_000_000):
    """Slices of batch whose text in column has about `most` bytes at most (one row at least), so that work arrays stay small."""
    col = batch.column(column)
    if len(col) == 0:
        return
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    at = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    begin = 0
    while begin < len(col):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end
