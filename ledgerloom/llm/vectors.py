"""Vector columns as integer matrices, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def finite(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the vectors that are whole, their lengths, and their components end to end as doubles.

    A vector is whole if it is not null, holds neither nulls nor non-finite
    numbers and, where ``length`` is given, has exactly so many components.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.maximum(lengths, 0)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (lengths >= 0) & (bad[ends] == bad[ends - sizes])
    if length is not None:
        good &= lengths == length
    return np.flatnonzero(good), lengths[good], values[np.repeat(good, sizes)]


def scaled(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x), held at plus or minus ``limit``, as 32-bit integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values), -limit, limit).astype(np.int32)


def padded(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """A matrix with one row per vector; missing components are zero."""
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out
