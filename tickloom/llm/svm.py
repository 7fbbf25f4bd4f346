"""Linear support vector machines with squared hinge loss, trained in numpy."""

from __future__ import annotations

import numpy as np


def train(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias for labels -1/+1; accelerated gradient, classes weighted equally."""
    n, m = x.shape
    xb = np.hstack([x, np.ones((n, 1), x.dtype)])
    y = y.astype(x.dtype)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    v = np.ones(m + 1, x.dtype) / np.sqrt(m + 1)
    for _ in range(20):  # largest curvature by power iteration
        v = xb.T @ (share * (xb @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1 / (2 * c * top * 1.1 + 1)
    w = z = np.zeros(m + 1, x.dtype)
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (xb @ z))
        grad = z - 2 * c * (xb.T @ (share * y * gap))
        nxt = z - rate * grad
        z = nxt + x.dtype.type(k / (k + 3)) * (nxt - w)
        w = nxt
    return w[:-1], float(w[-1])


def slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Slope of a logistic curve through the margins, by Newton steps with a weak prior."""
    a = 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin, -50, 50)))
        grad = float(np.sum(((y > 0) - p) * margin)) - 0.01 * (a - 2)
        curve = float(np.sum(p * (1 - p) * margin * margin)) + 0.01
        a = min(20.0, max(0.1, a + grad / curve))
    return a
