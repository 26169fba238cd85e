"""Embedding columns as NumPy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def blocks(ids: pa.Array, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) by dimension: float64 rows of the vectors that are not null, zero or empty and hold finite numbers only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    has_id = ids.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(sizes[sizes > 0]).tolist():
        place = np.flatnonzero((sizes == d) & has_id)
        flat = column.take(pa.array(place)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        if good.any():
            out.append((place[good], x[good]))
    return out
