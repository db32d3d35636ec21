"""Vectors of floating-point components as rows of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_vectors(
    column: pa.Array, scale: int, limit: int, dims: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a vector to use, its lengths, and ``floor(scale * x)`` of all its components in a row.

    A null vector, a null or non-finite component, or a length other than ``dims`` leaves a row out.
    Components beyond ``limit`` have no exact result in 64 bits, so they end the job.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan"))
    x = flat.to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
    if dims is not None:
        good &= lengths == dims
    used = x[np.repeat(good, np.maximum(lengths, 0))]
    with np.errstate(over="ignore"):
        whole = np.floor(used * float(scale))
    if len(whole) and np.abs(whole).max() > limit:
        raise ValueError(f"a component times {scale} is beyond {limit}: no exact 64-bit result")
    return np.flatnonzero(good), lengths[good], whole.astype(np.int64)
