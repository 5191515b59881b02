"""What the vector operators share: usable vectors, and matrices from Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null and holds only finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def matrix(vectors: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0), kind)
    at = vectors.offsets.to_numpy()
    sizes, flat = np.diff(at), vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    out = np.zeros((len(sizes), int(sizes.max())), kind)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out
