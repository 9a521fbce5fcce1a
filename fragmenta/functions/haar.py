"""Haar transforms of signals and images, and which layer a coefficient belongs to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = np.float32(np.sqrt(2.0))


def forward_1d(x: np.ndarray, levels: int) -> np.ndarray:
    x, n = np.array(x, np.float32), x.shape[-1]
    for _ in range(levels):
        a, b = x[..., 0:n:2].copy(), x[..., 1:n:2].copy()
        n //= 2
        x[..., :n], x[..., n : 2 * n] = (a + b) / ROOT, (a - b) / ROOT
    return x


def inverse_1d(x: np.ndarray, levels: int) -> np.ndarray:
    x = np.array(x, np.float32)
    for level in range(levels, 0, -1):
        n = x.shape[-1] >> level
        s, d = x[..., :n].copy(), x[..., n : 2 * n].copy()
        x[..., 0 : 2 * n : 2], x[..., 1 : 2 * n : 2] = (s + d) / ROOT, (s - d) / ROOT
    return x


def forward_2d(x: np.ndarray, levels: int) -> np.ndarray:
    """Rows, then columns, of the part that the level before left."""
    x = np.array(x, np.float32)
    for level in range(levels):
        h, w = x.shape[0] >> level, x.shape[1] >> level
        part = forward_1d(x[:h, :w], 1)
        x[:h, :w] = forward_1d(part.T, 1).T
    return x


def inverse_2d(x: np.ndarray, levels: int) -> np.ndarray:
    x = np.array(x, np.float32)
    for level in range(levels - 1, -1, -1):
        h, w = x.shape[0] >> level, x.shape[1] >> level
        part = inverse_1d(x[:h, :w].T, 1).T
        x[:h, :w] = inverse_1d(part, 1)
    return x


def layer_1d(i: np.ndarray, n: int, levels: int) -> np.ndarray:
    """0 for the coarse part, then finer details in higher layers."""
    i = np.asarray(i)
    out = np.zeros(i.shape, int)
    for layer in range(1, levels + 1):
        out[i >= n >> (levels - layer + 1)] = layer
    return out


def layer_2d(x: np.ndarray, y: np.ndarray, w: int, h: int, levels: int) -> np.ndarray:
    return np.maximum(layer_1d(x, w, levels), layer_1d(y, h, levels))


def layer_column(i: Column, n: int, levels: int) -> Column:
    out = F.lit(0)
    for layer in range(1, levels + 1):
        out = F.when(i >= n >> (levels - layer + 1), layer).otherwise(out)
    return out


def forward_array(n: int, levels: int):
    """A function of columns: the 1-D transform of the first n values of an array, in double precision.

    Vectorised over the batch; as nested array expressions each level would hold the one below four times.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(values: pd.Series) -> pd.Series:
        if not len(values):
            return values
        x = np.stack([np.asarray(v, np.float64)[:n] for v in values])
        for level in range(levels):
            a, b = x[:, 0 : n >> level : 2].copy(), x[:, 1 : n >> level : 2].copy()
            half = n >> (level + 1)
            x[:, :half], x[:, half : 2 * half] = (a + b) / np.sqrt(2.0), (a - b) / np.sqrt(2.0)
        return pd.Series(list(x))

    return run
