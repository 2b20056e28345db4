"""Follow-the-regularised-leader (proximal) with elastic-net penalties, for sparse rows and one or more classes."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate learning rates; L1 leaves a coordinate at exactly 0 until its evidence exceeds `l1`.

    k = 1 is logistic regression, k > 1 multinomial. The last coordinate is the intercept, without penalty.
    """

    def __init__(self, size: int, k: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((size + 1, k))
        self.n = np.zeros((size + 1, k))
        self.alpha, self.beta, self.l1, self.l2, self.k = alpha, beta, l1, l2, k

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def intercept(self) -> np.ndarray:
        return -self.z[-1] * self.alpha / (self.beta + np.sqrt(self.n[-1]))

    def step(self, at: np.ndarray, x: np.ndarray, target: int, weight: float = 1.0) -> None:
        """One row: its coordinates (distinct), their values and its class (for k = 1: 0 or 1)."""
        w = self.weights(at)
        logits = x @ w + self.intercept()
        if self.k == 1:
            error = 1 / (1 + np.exp(-np.clip(logits, -35, 35))) - target
        else:
            error = softmax(logits[None, :])[0]
            error[target] -= 1
        error = error * weight
        g = x[:, None] * error
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more
        b, n, more = self.intercept(), self.n[-1], self.n[-1] + error * error
        self.z[-1] += error - (np.sqrt(more) - np.sqrt(n)) / self.alpha * b
        self.n[-1] = more


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
