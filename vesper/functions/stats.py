"""Statistics over benchmark timings: scaling fits and a rank test, on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Fit:
    #: Lowest power first.
    coefficients: np.ndarray
    r2: float
    adjusted_r2: float
    rmse: float


def polynomial_fit(x, y, degree: int = 1) -> Fit:
    """Least squares of y on powers of x."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    powers = np.vander(x, degree + 1, increasing=True)
    found, *_ = np.linalg.lstsq(powers, y, rcond=None)
    rest = float(((y - powers @ found) ** 2).sum())
    spread = float(((y - y.mean()) ** 2).sum())
    r2 = 1 - rest / spread if spread else 1.0
    free = y.size - degree - 1
    return Fit(found, r2, 1 - (1 - r2) * (y.size - 1) / free if free > 0 else r2, math.sqrt(rest / y.size))


def ranks(values: np.ndarray) -> np.ndarray:
    """Mean ranks from 1, ties shared."""
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[at]


def mann_whitney(a, b) -> tuple[float, float]:
    """U of the first sample and its two-sided p by the normal approximation with ties and continuity corrected."""
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    both = np.concatenate([a, b])
    n, m, total = a.size, b.size, a.size + b.size
    u = float(ranks(both)[:n].sum() - n * (n + 1) / 2)
    _, tied = np.unique(both, return_counts=True)
    variance = n * m / 12 * (total + 1 - float((tied**3 - tied).sum()) / (total * (total - 1)))
    if variance == 0:
        return u, 1.0
    z = (abs(u - n * m / 2) - 0.5) / math.sqrt(variance)
    return u, min(1.0, math.erfc(z / math.sqrt(2)))
