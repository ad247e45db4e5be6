"""Many short rows of numbers as one value of bytes.

Bytes go from storage to a task's matrix in one piece, arrays value by value and short values row by row. A value holds a few
kilobytes, so an Arrow batch of them stays small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

VALUE_BYTES = 4096


def pack(rows: np.ndarray) -> pa.RecordBatch:
    """The rows of a matrix, one after the other, as the column ``packed``."""
    data = np.ascontiguousarray(rows)
    width = data.strides[0]
    per = max(1, VALUE_BYTES // width)
    ends = np.append(np.arange(0, len(data), per), len(data)).astype(np.int32) * width
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.array(ends, pa.int32()).buffers()[1], pa.py_buffer(data.tobytes())])],
        names=["packed"])


def unpack(column: pa.Array, width: int) -> np.ndarray:
    """The rows of all values of a column, as bytes; ``width`` is a row's number of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8, offsets[-1] - offsets[0], offsets[0]).reshape(-1, width)
