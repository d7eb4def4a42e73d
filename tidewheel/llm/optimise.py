"""Minimisation of a smooth function on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int = 60, memory: int = 10) -> np.ndarray:
    """Where L-BFGS with a backtracking line search arrives from w. loss gives the value and the gradient."""
    f, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, back = g.copy(), []
        for s, q, rho in reversed(steps):
            back.append(a := rho * (s @ d))
            d -= a * q
        if steps:
            s, q, _ = steps[-1]
            d *= (s @ q) / (q @ q)
        for (s, q, rho), a in zip(steps, reversed(back), strict=True):
            d += s * (a - rho * (q @ d))
        slope, t = g @ d, 1.0 if steps else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        if slope <= 1e-12:
            break
        for _ in range(20):
            f2, g2 = loss(w - t * d)
            if f2 <= f - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, q = -t * d, g2 - g
        done = f - f2 < 1e-9
        w, f, g = w + s, f2, g2
        if s @ q > 1e-12:
            steps = [*steps[-memory + 1 :], (s, q, 1 / (s @ q))]
        if done:
            break
    return w
