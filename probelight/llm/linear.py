"""Small linear models fitted with numpy on a bounded sample; tasks only score with them."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-regularised logistic regression by Newton steps (a few hundred features)."""
    x1 = np.column_stack((x, np.ones(len(x))))
    ridge = np.full(x1.shape[1], l2)
    ridge[-1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        slope = x1.T @ (p - y) + ridge * w
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(ridge), slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, l2: float = 0.1, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and biases of multinomial logistic regression."""
    n, d = x.shape
    w, b, t = np.zeros((d, classes)), np.zeros(classes), 1.0
    one = np.eye(classes)[y]
    top = 0.5 * (x * x).sum(axis=1).max(initial=1.0) + 0.5 + l2 / n
    vw, vb = w.copy(), b.copy()
    for _ in range(steps):
        p = softmax(x @ vw + vb)
        r = (p - one) / n
        nw, nb = vw - (x.T @ r + l2 * vw / n) / top, vb - r.sum(axis=0) / top
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of held-out scores that makes their probabilities most likely."""
    grid = np.geomspace(0.05, 10, 60)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(y.size), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
