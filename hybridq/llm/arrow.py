"""Arrow columns as numpy arrays without a Python object for each row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Binary array over `data`, cut at `starts`; the last slice ends with the data."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... start+length-1 of each span, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    kind = np.int32 if total + int(np.max(starts, initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - before).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def ids_array(column: pa.Array) -> np.ndarray:
    """An integer column as int64 with null as the smallest value."""
    return np.asarray(pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min))


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most `limit` bytes of `column`, or one row."""
    for batch in batches:
        cells = batch.column(column)
        at = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(cells), 0), dtype=np.int64))])
        low = 0
        while low < len(cells):
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
            yield batch.slice(low, high - low)
            low = high
