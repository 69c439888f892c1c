"""What the two vector operators share: cleaning, padding, k-means on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for vectors without null, NaN and infinite components."""
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & (F.size(v) > 0)


def matrix(column, width: int) -> np.ndarray:
    """Rows of a column of lists as doubles, padded with zeros to the width."""
    if all(len(v) == width for v in column):
        return np.array(list(column), np.float64).reshape(-1, width)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def sample(rows: DataFrame, key: str, column: str, most: int) -> list:
    """At most `most` values of a column: those with the smallest hashes of their key, the same in each run."""
    return [r[0] for r in rows.select(column, F.xxhash64(key, F.lit(11)).alias("_h"), key).orderBy("_h", key).limit(most).collect()]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - x[at : at + 4096] @ centres.T).argmin(1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """At most k centres of the rows of x; a fixed seed."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres
