"""Expressions on ARRAY<DOUBLE> vectors, and their values in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector over its length; a length below the floor counts as the floor."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(FLOOR)))


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, d): the vectors of an Arrow column, read as they are, without an object for each row. Nulls and vectors of several lengths are refused."""
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    if column.null_count or pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors are null or of several lengths")
    x = np.concatenate(values) if len(values) != 1 else values[0]
    return x.astype(np.float64, copy=False).reshape(len(column), -1 if len(column) else 0)
