"""Embeddings as rows of one matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite, F.lit(False))


def by_dimension(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, float64 matrix) of an Arrow list column, for each dimension in it."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets)
    values = np.asarray(column.values.cast(pa.float64()))
    n = np.diff(at)
    return [(i := np.flatnonzero(n == d), values[at[i][:, None] + np.arange(d)]) for d in np.unique(n)]
