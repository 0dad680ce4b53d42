"""Arrow columns as NumPy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Rows of text that a batch function sees at once.
ROWS = 1500


def blobs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return offsets, data


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists of numbers; a null is empty."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes)), values


def to_batch(**columns: np.ndarray | pa.Array | list) -> pa.RecordBatch:
    """A record batch of the named columns."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` on smaller batches; what its worker no longer needs goes back to the system in
    the end, since workers stay with their executor between tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
