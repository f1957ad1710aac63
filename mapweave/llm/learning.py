"""Small models fitted on the driver from bounded samples, and the sampling of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def sampled(rows: DataFrame, n: int, order: Column) -> DataFrame:
    """The n rows that come first in a pseudo-random order."""
    return rows.orderBy(order).limit(n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Scaled:
    """Features brought to mean 0 and deviation 1 and clipped."""

    def __init__(self, x: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights, the constant last, by Newton steps on the penalised log loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * max(1, len(x)))
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w
