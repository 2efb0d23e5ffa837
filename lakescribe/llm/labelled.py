"""Labelled rows for the classifiers, and calibration of raw scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labels_of(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(_label_id, _label): one row per labelled id. Null ids and labels are no labels; of several labels of an id the largest counts."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return rows.groupBy(F.col(id_col).alias("_label_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))


def bounded_sample(labels: DataFrame, max_rows: int, learnable: Column) -> DataFrame:
    """At most ``max_rows`` learnable labels, those with the smallest hashes, so that a rerun takes the same."""
    return labels.filter(learnable).orderBy(F.xxhash64(F.col("_label_id"), F.lit(11)), "_label_id").limit(max_rows)


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins: places (block centres) and non-decreasing rates.

    ``x`` ascending bin places, ``n`` rows and ``positive`` positive rows of each bin.
    """
    blocks: list[list[float]] = []
    for a, w, p in zip(x.tolist(), n.tolist(), positive.tolist()):
        if w:
            blocks.append([a * w, w, p])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [s + t for s, t in zip(blocks[-1], last)]
    if not blocks:
        return np.zeros(0), np.zeros(0)
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], (b[:, 2] + 0.5) / (b[:, 1] + 1.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge-penalised logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-8:
            break
    return w
