"""Logistic regression over sparse present-or-absent features, with numpy."""

from __future__ import annotations

import numpy as np


def fit_softmax(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, n_features: int, n_classes: int, l2: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) for entries (row, column, value), by accelerated gradient descent with line search.

    ``l2`` is the penalty a row on the squared weights; the bias is not penalised.
    """
    n = len(labels)
    want = np.zeros((n, n_classes))
    want[np.arange(n), labels] = 1
    weights, bias = np.zeros((n_features, n_classes)), np.log((want.sum(axis=0) + 1) / (n + n_classes))
    ahead_w, ahead_b, step, momentum = weights, bias, 1.0, 1.0

    def scores(w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(rows, weights=values * w[columns, c], minlength=n) for c in range(n_classes)], axis=1) + b

    def loss(w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
        z = scores(w, b)
        z -= z.max(axis=1, keepdims=True)
        log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return float(-(want * log).sum() / n + l2 / 2 * (w**2).sum()), np.exp(log)

    for _ in range(rounds):
        value, p = loss(ahead_w, ahead_b)
        gap = (p - want) / n
        grad_w = np.stack([np.bincount(columns, weights=values * gap[rows, c], minlength=n_features) for c in range(n_classes)], axis=1) + l2 * ahead_w
        grad_b = gap.sum(axis=0)
        size = float((grad_w**2).sum() + (grad_b**2).sum())
        if size < 1e-12:
            break
        while True:
            new_w, new_b = ahead_w - step * grad_w, ahead_b - step * grad_b
            if loss(new_w, new_b)[0] <= value - step / 2 * size or step < 1e-9:
                break
            step /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        ahead_w, ahead_b = new_w + pull * (new_w - weights), new_b + pull * (new_b - bias)
        weights, bias, momentum, step = new_w, new_b, following, step * 1.3
    return weights, bias


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)
