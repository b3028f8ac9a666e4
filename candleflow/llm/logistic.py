"""Ridge logistic regression by damped Newton steps, for small feature tables
that are bounded samples (fitted on the driver)."""

from __future__ import annotations

import math


def fit_logistic(x, y, ridge: float = 1.0, prior=None, rounds: int = 50) -> list[float]:
    """Weights, the first for the constant, of ``y`` (0/1) on the rows of
    ``x``.  ``prior`` is the point the ridge pulls to (default 0; the constant
    is hardly pulled).  No rows: the prior."""
    import numpy as np

    x = np.asarray(x, float)
    x = np.c_[np.ones(len(x)), x] if len(x) else np.zeros((0, len(prior or [0])))
    y = np.asarray(y, float)
    w0 = np.zeros(x.shape[1]) if prior is None else np.asarray(prior, float)
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-3
    w = w0.copy()

    def loss(v):
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (pull * (v - w0) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + pull * (w - w0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        last, now = now, loss(w)
        if last - now < 1e-9 * (1 + abs(last)):
            break
    return [float(v) for v in w]


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(max(z, -700.0)) / (1 + math.exp(max(z, -700.0)))
