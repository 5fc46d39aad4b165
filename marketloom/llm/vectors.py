"""Vectors in tables: which take part, classes of equal vectors, and their rows in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True for vectors without null or non-finite components that are not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(vec, lambda x: x != 0)


#: Vectors whose largest component is outside these bounds are scaled: squares would overflow or vanish.
_TINY, _HUGE = 2.0 ** -300, 2.0 ** 300


def scaled(vec: Column) -> Column:
    """A vector of doubles; one of extreme size is multiplied by a power of two, which changes no angle.

    The power is applied in two halves, because it may itself exceed a double.
    """
    largest = F.array_max(F.transform(vec, F.abs))
    half = F.pow(F.lit(2.0), F.floor(-F.log2(largest) / 2).cast("double"))
    return F.when(largest.between(_TINY, _HUGE), vec).otherwise(F.transform(vec, lambda x: x * half * half))


def hashed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (doubles) and a hash of 128 bits of every row that takes part; rows without an id do not."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    rows = rows.withColumn("vec", scaled(F.col("vec")))
    return rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of vectors of one dimension as rows of doubles."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def list_array(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(dim)), pa.array(rows.ravel(), kind))
