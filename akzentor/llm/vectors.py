"""What the vector operators share: which vectors count, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """True for vectors that aren't null, empty or zero and hold only finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    whole = ~F.array_contains(v, F.lit(float("nan")))  # null, so not true, where a component is null
    low, high, most = F.array_min(v), F.array_max(v), F.lit(float("inf"))
    return F.coalesce(whole & (high < most) & (low > -most) & ((low != 0) | (high != 0)), F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of those rows) by dimension, for a list column without nulls."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[ends[rows][:, None] + np.arange(d)]


def projections(dim: int, n: int, seed: int) -> np.ndarray:
    """Random directions that every worker makes alike."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))
