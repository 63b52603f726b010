"""Vector columns as numpy matrices; which vectors can take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Whether a vector is not null, has no null, NaN or infinite component, and is not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vec.isNotNull() & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0), F.lit(False))


def packed(vec: pa.Array) -> list[bytes]:
    """Each list as the bytes of its doubles."""
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype("<f8")
    ends = np.cumsum(np.array(vec.value_lengths().to_pylist(), np.int64)) if len(vec) else np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(int) if len(vec) else ends
    return [flat[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]


def matrix(vec: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vec), -1)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(x, x))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of the components, so that equal rows give equal results everywhere."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total
