"""L-BFGS with a line search for the strong Wolfe conditions, in numpy: minimises a function given with its gradient."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class Found:
    x: np.ndarray
    value: float
    iterations: int
    evaluations: int
    converged: bool


def _search(f: Objective, x: np.ndarray, direction: np.ndarray, value: float, slope: float, step: float, most: int = 25):
    """A step that lowers the value enough and flattens the slope (bisection between a good and a bad step)."""
    low, high, best = 0.0, np.inf, None
    for n in range(1, most + 1):
        at = x + step * direction
        new, gradient = f(at)
        rise = gradient @ direction
        if not np.isfinite(new) or new > value + 1e-4 * step * slope:
            high = step
        elif rise < 0.9 * slope:
            low, best = step, (at, new, gradient)
        elif rise > -0.9 * slope:
            high, best = step, (at, new, gradient)
        else:
            return at, new, gradient, n
        step = 2 * low if np.isinf(high) else (low + high) / 2
    return (*best, most) if best else (x, value, None, most)


def minimise(f: Objective, x: np.ndarray, memory: int = 10, tolerance: float = 1e-5, most: int = 200) -> Found:
    """Until the gradient's norm is below tolerance times x's (1 at least), or most iterations."""
    value, gradient = f(x)
    evaluations, pairs = 1, deque(maxlen=memory)
    for n in range(most):
        if np.linalg.norm(gradient) <= tolerance * max(1.0, np.linalg.norm(x)):
            return Found(x, value, n, evaluations, True)
        q, scales = gradient.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            scales.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(scales), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        direction = -q
        slope = gradient @ direction
        if slope >= 0:
            pairs.clear()
            direction, slope = -gradient, -(gradient @ gradient)
        at, new, after, used = _search(f, x, direction, value, slope, 1.0 if pairs else 1.0 / max(np.linalg.norm(gradient), 1e-12))
        evaluations += used
        if after is None:
            return Found(x, value, n, evaluations, False)
        s, y = at - x, after - gradient
        if s @ y > 1e-12:
            pairs.append((s, y))
        x, value, gradient = at, new, after
    return Found(x, value, most, evaluations, False)
