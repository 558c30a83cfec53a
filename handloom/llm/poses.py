"""Poses as matrices inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VALUES = 63
#: Landmark 9 has values 27 to 29 (from 0); its length is the unit.
UNIT = slice(27, 30)


def scaled_poses(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(usable, matrix of the usable): 63 finite values, not all zero, divided by the length of landmark 9.

    Null poses, null entries, other lengths and poses whose landmark 9 has no length are not usable. ``column`` holds lists,
    or usable poses as ``packed`` gives them.
    """
    if pa.types.is_binary(column.type):
        m = _unpacked(column)
        return np.ones(len(m), bool), m / np.sqrt((m[:, UNIT] ** 2).sum(axis=1))[:, None]
    right = pc.fill_null(pc.equal(pc.list_value_length(column), VALUES), False)
    ok = right.to_numpy(zero_copy_only=False).astype(bool)
    flat = pc.list_flatten(column.filter(right))
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, VALUES)
    unit = np.sqrt((m[:, UNIT] ** 2).sum(axis=1))
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1) & (unit > 0)
    ok[np.nonzero(ok)[0][~good]] = False
    return ok, m[good] / unit[good][:, None]


def packed(column: pa.Array) -> pa.Array:
    """Usable poses as bytes: to the JVM each is one value, where a list is 63. Precision stays as it is."""
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    ends = np.arange(len(column) + 1, dtype=np.int32) * (VALUES * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array) -> np.ndarray:
    n = len(column)
    if not n:
        return np.empty((0, VALUES))
    first, second = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + 2]
    kind = np.float32 if second - first == 4 * VALUES else np.float64
    return np.frombuffer(column.buffers()[2], kind, n * VALUES, int(first)).astype(np.float64).reshape(n, VALUES)


def lists(matrix: np.ndarray, kind=pa.float64()) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    ends = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(matrix.ravel(), kind))
