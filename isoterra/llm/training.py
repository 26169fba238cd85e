"""Labelled rows that models learn from, folds, and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Labelled rows of each class that a model is fitted on.
SAMPLE = 2500


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that no model learns labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learning_rows(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labelled rows that a model may learn from, one for each doc_id."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    return ids.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + keep
        step = np.linalg.solve(h, z.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def soft_logistic(x: np.ndarray, chance: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the logistic curve nearest to the chances, by Newton's method with halved steps."""
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - chance * z)) + 5e-7 * float(w @ w)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - chance)) + 1e-6 * w)
        while loss(w - step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
