"""Multinomial logistic regression with FTRL-proximal updates and elastic net, and temperature calibration."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """Follow the regularised leader: a weight is zero until its summed gradient passes l1.

    X is dense in blocks of rows (features are hashed, so the width is fixed).
    """

    def __init__(self, width: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3) -> None:
        self.z, self.n = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self) -> np.ndarray:
        shrunk = np.sign(self.z) * np.maximum(np.abs(self.z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n)) / self.alpha + self.l2)

    def step(self, x: np.ndarray, y: np.ndarray, row_weight: np.ndarray) -> None:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        w = self.weights()
        p = softmax(x @ w)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ (p * row_weight[:, None] / len(y))
        sigma = (np.sqrt(self.n + g * g) - np.sqrt(self.n)) / self.alpha
        self.z += g - sigma * w
        self.n += g * g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        count = np.bincount(y, minlength=self.z.shape[1]).astype(float)
        row_weight = (len(y) / (max(1, (count > 0).sum()) * np.maximum(count, 1)))[y]
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                self.step(x[rows], y[rows], row_weight[rows])
        return self.weights()


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least log loss on rows the fit has not seen."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
