"""Helpers of the vector operators: which vectors take part, and array columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def finite(name: str) -> Column:
    """Whether a vector has neither null nor non-finite components; a null vector gives false."""
    bounded = F.forall(name, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(bounded, F.lit(False))


def lengths(df: DataFrame, size: Column) -> list[int]:
    """The vector lengths that occur. Vectors of different lengths are different spaces; there are a handful at most."""
    return sorted(r[0] for r in df.select(size).distinct().collect())


def matrix(column: pa.ChunkedArray | pa.Array, kind=None) -> np.ndarray:
    """A list column whose lists all have one length, as a matrix; no list may be null."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = whole.flatten().to_numpy(zero_copy_only=False)
    out = values.reshape(len(whole), -1) if len(whole) else values.reshape(0, 0)
    return out if kind is None else out.astype(kind, copy=False)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows.reshape(-1), kind))
