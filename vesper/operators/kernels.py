"""numpy kernels over samples in order of time: sliding extremes over time windows, and until."""

from __future__ import annotations

import numpy as np


def extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray, largest: bool, empty: float) -> np.ndarray:
    """max (or min) of values[low:high] for each pair, by a table of power-of-two runs; ``empty`` where there is none."""
    pick = np.maximum if largest else np.minimum
    kind = np.int64 if values.dtype == np.int64 else np.float64
    out = np.full(low.size, empty, dtype=kind)
    size = high - low
    runs, step = values.astype(kind), 1
    while (some := np.flatnonzero((size >= step) & (size < 2 * step))).size or (size >= 2 * step).any():
        out[some] = pick(runs[low[some]], runs[high[some] - step])
        if 2 * step > values.size:
            break
        runs = pick(runs[: runs.size - step], runs[step:])
        step *= 2
    return out


def window(t: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each time the rows in [t + start, t + end]."""
    return np.searchsorted(t, t + start, side="left"), np.searchsorted(t, t + end, side="right")


NEVER = np.iinfo(np.int64).max


def reached(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row i, sup over rows j in [low, high) of min(right(j), inf of left over [i, j]), in n log n.

    As left's infimum only falls with j, this is the least of: right's supremum over the window; left's infimum
    before the window; and the unbounded one from the window's first row on. The last obeys u = min(left, max(right, u of the next
    row)). Such steps clamp u between two numbers, and clamps make clamps, so all rows come by doubling.
    """
    n = left.size
    least_of_all = -NEVER if left.dtype == np.int64 else -np.inf
    if not n:
        return np.zeros(0, dtype=left.dtype)
    most = left
    least = np.minimum(most, right)
    step = 1
    while step < n:
        below, above = np.maximum(least[:-step], least[step:]), np.maximum(least[:-step], most[step:])
        least, most = (np.concatenate([np.minimum(most[:-step], x), y[-step:]]) for x, y in ((below, least), (above, most)))
        step *= 2
    forever = np.where(low < n, least[np.minimum(low, n - 1)], least_of_all)
    held = extremes(left, np.arange(n), low, False, -least_of_all)
    return np.minimum(np.minimum(extremes(right, low, high, True, least_of_all), held), forever)


def until(t: np.ndarray, left: np.ndarray, right: np.ndarray, start: int, end: int) -> np.ndarray:
    """sup over t' in [t + start, t + end] of min(right(t'), inf of left over [t, t'])."""
    return reached(left.astype(np.float64), right.astype(np.float64), *window(t, start, end))


def eager_until(t, left, dl, right, dr, start: int, end: int, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verdicts of until with the times at which they are decided (NEVER if not yet). d of undecided operands is NEVER.

    True once some t' has a decided true right operand and decided true left ones up to it; false once a decided
    false left operand ends the choice of t', with the right ones before it decided false and the one there decided; else
    at closure. The first of these times is until over negated times of decision, the second a largest time over the rows up to the next
    decided false left operand.
    """
    n = t.size
    if not n:
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
    low, high = window(t, start, end)
    ends = np.minimum.accumulate(np.where((dl != NEVER) & ~left, np.arange(n), n)[::-1])[::-1]
    stop = np.minimum(ends, high)
    hit = right & (dr != NEVER)
    sure_true = -reached(-dl, -np.where(hit, dr, NEVER), low, stop)
    hits = np.concatenate([[0], np.cumsum(hit)])
    none = hits[np.maximum(low, stop)] == hits[low]
    at = np.minimum(ends, n - 1)
    sure_false = np.maximum(extremes(dr, low, stop, True, 0), np.maximum(dl[at], dr[at]))
    sure_false = np.where((ends < high) & none, sure_false, NEVER)
    value = sure_true != NEVER
    return value, np.minimum(np.where(value, sure_true, sure_false), close)
