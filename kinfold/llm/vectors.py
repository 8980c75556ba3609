"""What the two vector searches share: valid vectors as bytes, and the merge of shard results."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: vec_id and vector columns.
ID, VECTOR = "vec_id", "embedding"


def valid(vectors: DataFrame, exact: bool = False) -> DataFrame:
    """vec_id, embedding: rows with an id and a non-empty vector of finite components.

    Vectors are array<double>; with `exact`, array<float> stays what it is.
    """
    bad = F.exists(VECTOR, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = "array<float>" if exact and dict(vectors.dtypes)[VECTOR] == "array<float>" else "array<double>"
    return vectors.select(F.col(ID).cast("long").alias(ID), F.col(VECTOR).cast(kind).alias(VECTOR)).where(F.col(ID).isNotNull() & F.col(VECTOR).isNotNull() & (F.size(VECTOR) > 0) & ~bad)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column as doubles, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, dims))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    if (size == dims).all():
        return flat.reshape(-1, dims).astype(np.float64, copy=False)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def extent(vectors: DataFrame) -> tuple[int, int]:
    """Number of vectors and the longest length."""
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size(VECTOR))).first()
    return int(n), int(dims or 1)


def salt(n: int) -> Column:
    return F.pmod(F.xxhash64(ID), F.lit(max(1, n))).cast("int")


def blocks(rows: int, size: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / size))


def best(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """The k best of each query from its shards' bests: largest score first, ties to the smaller vec_id."""
    once = found.groupBy("query_id", ID).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), ID)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", ID, F.col("score").cast(score_type).alias("score"))
