"""Logistic regression of a few features, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Slope and offset that fit P(y = 1), by Newton's method; y may lie between 0 and 1."""
    z = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(z)) if weight is None else weight
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])
