"""Sparse logistic regression in numpy, for classifiers that are fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class Rows:
    """Rows of hashed features: ``at`` begins each row in ``index``; each feature counts as its value."""

    def __init__(self, at: np.ndarray, index: np.ndarray, value: np.ndarray):
        used = value != 0
        self.n, owner = len(at) - 1, np.repeat(np.arange(len(at) - 1), np.diff(at))[used]
        #: The features in use, and each entry's place among them.
        self.features, self.place = np.unique(index[used], return_inverse=True)
        self.owner, self.value = owner, value[used].astype(np.float64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """rows x outputs; w: all features x outputs."""
        return self.dot_used(w[self.features])

    def dot_used(self, w: np.ndarray) -> np.ndarray:
        out = np.empty((self.n, w.shape[1]))
        for k in range(w.shape[1]):
            out[:, k] = np.bincount(self.owner, self.value * w[:, k][self.place], self.n)
        return out

    def t_dot_used(self, r: np.ndarray) -> np.ndarray:
        """features in use x outputs."""
        out = np.empty((len(self.features), r.shape[1]))
        for k in range(r.shape[1]):
            out[:, k] = np.bincount(self.place, self.value * r[:, k][self.owner], len(out))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, target: np.ndarray, n: int, *, link=sigmoid, l2: float = 1e-6, l1: float = 0.0, epochs: int = 80, rate: float = 0.5, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and biases by AdaGrad over all rows, with soft thresholding for ``l1``; ``target``: rows x outputs of 0 to 1."""
    w, b = np.zeros((len(rows.features), target.shape[1])), np.zeros(target.shape[1])
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    weight = np.ones(len(target)) if weight is None else weight
    total = max(weight.sum(), 1e-9)
    for _ in range(epochs):
        r = (link(rows.dot_used(w) + b) - target) * weight[:, None] / total
        d, e = rows.t_dot_used(r) + l2 * w, r.sum(0)
        gw += d * d
        gb += e * e
        w -= rate * d / np.sqrt(gw)
        if l1:
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / np.sqrt(gw), 0)
        b -= rate * e / np.sqrt(gb)
    out = np.zeros((n, target.shape[1]))
    out[rows.features] = w
    return out, b
