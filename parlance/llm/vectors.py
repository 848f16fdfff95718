"""What the operators on embeddings share: which rows count, and their entries as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete(embeddings: DataFrame, id_column: str, vector_column: str, label_column: str | None = None) -> tuple[DataFrame, int]:
    """(rows with vec_id, vector and, if asked for, label; their dimension): those whose vector has finite entries only.

    The dimension is the most frequent length of such vectors (of equally frequent ones the greatest); rows of another
    length have no place in a matrix and are left out too. Without any row the dimension is 0.
    """
    columns = [F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")]
    named = embeddings.select(*columns, *([F.col(label_column).alias("label")] if label_column else []))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = named.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd)
    most = whole.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return whole.filter(F.size("vector") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The entries of a column of arrays of length ``d``."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), d)


def floors(values: np.ndarray, factor: int, bound: int) -> np.ndarray:
    """floor(factor * value) as whole numbers; beyond ``bound`` either way they stay there."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(values * factor, -bound, bound)).astype(np.int64)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of arrays."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))
