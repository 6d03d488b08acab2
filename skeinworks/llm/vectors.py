"""Shared handling of vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dimension(rows: DataFrame, vector: str) -> int:
    """The most frequent length of a vector; 0 without any."""
    got = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return got.d if got else 0


def usable(vector: str, dim: int) -> Column:
    """Vectors of this length that are not zero and hold no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def rows_of(packed, dim: int, kind: str = "<f8") -> np.ndarray:
    """Packed numbers of one vector to a row, as doubles."""
    return np.frombuffer(b"".join(packed), kind).reshape(-1, dim).astype(np.float64)


def fixed(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """A column of binaries, each of `width` numbers of a kind, as a matrix."""
    parts = [c.cast(pa.binary()) for c in column.chunks if len(c)]
    rows = [np.frombuffer(c.buffers()[2], kind, len(c) * width, np.frombuffer(c.buffers()[1], np.int32)[c.offset]).reshape(-1, width) for c in parts]
    return np.concatenate([np.zeros((0, width), kind), *rows])


def packed(x: np.ndarray) -> pa.Array:
    size = x.shape[1] * x.itemsize
    data = np.ascontiguousarray(x).tobytes()
    return pa.array([data[k : k + size] for k in range(0, len(data), size)], pa.binary())


def sample(rows: DataFrame, key: str, vector: str, size: int) -> np.ndarray:
    """Up to `size` vectors, chosen by a hash of their id, as doubles on the driver."""
    got = rows.orderBy(F.xxhash64(key), key).limit(size).select(vector).toPandas()[vector]
    return np.array(got.tolist(), np.float64)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm; k is at most the number of rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
