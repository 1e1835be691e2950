"""Vectors of Arrow batches as NumPy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def known_vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, matrix in double precision) of a list column, for each length of vector in it. Rows
    that are null, or hold null or non-finite components, are in none; empty vectors have width 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()  # leaves out what null lists may hide
    sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    here = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), float)
    first = np.cumsum(sizes) - sizes
    odd = np.r_[0, np.cumsum(~np.isfinite(values))]
    here &= odd[first + sizes] == odd[first]
    for width in np.unique(sizes[here]).tolist():
        rows = np.flatnonzero(here & (sizes == width))
        yield width, rows, values[first[rows][:, None] + np.arange(width)]
