"""Follow-the-regularised-leader training of sparse linear models on a bounded sample."""

from __future__ import annotations

import numpy as np


def softmax(scores: np.ndarray) -> np.ndarray:
    top = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return top / top.sum(axis=-1, keepdims=True)


class Ftrl:
    """Multinomial FTRL-proximal: per-coordinate rates, L1 sparsity, L2 shrinkage.

    One weight column per class; two classes may use one column (``classes=1``), which is logistic regression.
    The last coordinate is the bias and is not penalised.
    """

    def __init__(self, size: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((size + 1, classes))
        self.n = np.zeros((size + 1, classes))
        self.bias = size

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)[:, None]
        l2 = np.where(at == self.bias, 0.0, self.l2)[:, None]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def step(self, at: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
        at, value = np.append(at, self.bias), np.append(value, 1.0)
        w = self._weights(at)
        score = value @ w
        if w.shape[1] == 1:
            error = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - label
        else:
            error = softmax(score)
            error[label] -= 1
        g = weight * value[:, None] * error
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def fit(self, rows: list[tuple], epochs: int, seed: int = 7) -> np.ndarray:
        """Weights after ``epochs`` passes over rows of (coordinates, values, label) or (..., weight)."""
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                self.step(*rows[i])
        return self._weights(np.arange(self.bias + 1))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, gold = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
