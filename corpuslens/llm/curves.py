"""Logistic curves fitted by damped Newton steps."""

from __future__ import annotations

import numpy as np

STEEPEST = 50.0


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: float, weight: np.ndarray | None = None) -> np.ndarray:
    """A logistic curve pulled towards ``start``, which also is what little data leave.

    Each step is halved until the loss falls (the loss is convex, so this ends at its only minimum); coefficients stay
    within ``STEEPEST`` of zero.
    """
    weight = np.ones(len(y)) if weight is None else weight

    def loss(w):
        z = x @ w
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + pull / 2 * np.sum((w - start) ** 2))

    w, now = start.astype(float), loss(start)
    for _ in range(100):
        p = logistic(x, w)
        g = x.T @ (weight * (p - y)) + pull * (w - start)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6:
            new = np.clip(w - size * step, -STEEPEST, STEEPEST)
            then = loss(new)
            if then < now:
                break
            size /= 2
        else:
            break
        done = now - then < 1e-9 * (1 + abs(now))
        w, now = new, then
        if done:
            break
    return w
