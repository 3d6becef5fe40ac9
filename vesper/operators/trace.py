"""A formula over the samples of one trace or of many, in numpy: the kernel behind long windows, streaming and the local monitor.

Many traces are evaluated at once on one axis of times: each has a stretch of its own, further from the next than any
window reaches, so what looks ahead finds its own trace's samples or none.

Every node has rows (time, values) on its own grid. Values are, by semantics: quantitative a robustness; qualitative
a truth; eager a truth and the time of its decision; rosi the ends of an interval. Missing samples have no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..plans.formula import Formula, micros
from . import kernels
from .kernels import NEVER

QUANTITATIVE, QUALITATIVE, EAGER, ROSI = "DelayedQuantitative", "DelayedQualitative", "EagerQualitative", "Rosi"
SEMANTICS = (QUALITATIVE, QUANTITATIVE, EAGER, ROSI)
INF = float("inf")


@dataclass
class Rows:
    t: np.ndarray
    a: np.ndarray
    b: np.ndarray | None = None


def _aligned(left: Rows, right: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.intersect1d(left.t, right.t, assume_unique=True, return_indices=True)


class Evaluator:
    """Evaluates normalized, bound formulas over ``samples`` (signal -> (times, values), times increasing).

    ``bases``: where each trace's stretch of the axis begins; one trace by default. ``newest``: for parts of traces, the time of the
    whole trace's last sample by node and stretch.
    """

    def __init__(
        self, samples: dict[str, tuple[np.ndarray, np.ndarray]], semantics: str, naive: bool = False, ignore_start: bool = False, growing: bool = False,
        bases: np.ndarray | None = None, newest: dict[int, np.ndarray] | None = None, grid: np.ndarray | None = None,
    ):
        self.bases, self.newest = bases, newest or {}
        self.samples, self.semantics, self.naive, self.ignore_start, self.growing = samples, semantics, naive, ignore_start, growing
        times = [t for t, _ in samples.values()]
        self.grid = grid if grid is not None else np.unique(np.concatenate(times)) if times else np.zeros(0, np.int64)
        self.now = int(self.grid[-1]) if self.grid.size else -1
        self.done: dict[int, Rows] = {}

    def rows(self, node: Formula) -> Rows:
        if node.key not in self.done:
            self.done[node.key] = getattr(self, "_" + node.kind)(node)
        return self.done[node.key]

    def closed(self, node: Formula) -> Rows:
        """The rows that delayed semantics emits: those whose whole future is there."""
        found = self.rows(node)
        keep = found.t + node.depth <= self.now
        return Rows(found.t[keep], found.a[keep])

    def owner(self, t: np.ndarray) -> np.ndarray:
        """The stretch that each time is in."""
        return np.zeros(t.size, dtype=np.int64) if self.bases is None else np.searchsorted(self.bases, t, side="right") - 1

    def last(self, t: np.ndarray) -> np.ndarray:
        """Of increasing times the last of each stretch, or -1."""
        ends = np.array([t.size]) if self.bases is None else np.append(np.searchsorted(t, self.bases[1:]), t.size)
        begins = np.concatenate([[0], ends[:-1]])
        return np.where(ends > begins, t[np.maximum(ends - 1, 0)] if t.size else -1, -1)

    def _open(self, node: Formula, t: np.ndarray) -> np.ndarray:
        """Whether windows of rows at t reach beyond their trace's newest row."""
        newest = self.newest[node.key] if node.key in self.newest else self.last(t)
        return t + node.depth > newest[self.owner(t)]

    def _released(self, t: np.ndarray, when: np.ndarray) -> np.ndarray:
        """In-order release within each trace: no row before those that come earlier."""
        if not when.size or self.bases is None:
            return np.maximum.accumulate(when) if when.size else when
        limit = np.append(self.bases[1:] - 1, NEVER)[self.owner(t)]  # after all of its own trace, before all of the next
        so_far = np.maximum.accumulate(np.where(when == NEVER, limit, when))
        return np.where(so_far == limit, NEVER, so_far)

    def frontier(self, node: Formula) -> int:
        """The time up to which a node's values are final, if samples still come: each signal's last, less the windows above."""
        if node.kind in ("gt", "lt"):
            t = self.samples.get(node.args[0], (np.zeros(0, np.int64),))[0]
            return int(t[-1]) if t.size else -1
        below = min((self.frontier(p) for p in node.parts), default=self.now)
        return below - (micros(node.args[1]) if node.kind in ("always", "eventually", "until") else 0)

    # Atoms
    def _constant(self, truth: bool) -> Rows:
        if self.semantics == QUALITATIVE:
            return Rows(self.grid, np.full(self.grid.size, truth))
        if self.semantics == EAGER:
            return Rows(self.grid, np.full(self.grid.size, truth), self.grid)
        value = np.full(self.grid.size, INF if truth else -INF)
        return Rows(self.grid, value, value)

    def _true(self, node):
        return self._constant(True)

    def _false(self, node):
        return self._constant(False)

    def _compare(self, node: Formula, sign: int) -> Rows:
        t, v = self.samples.get(node.args[0], (np.zeros(0, np.int64), np.zeros(0)))
        margin = sign * (v - node.args[1])
        if self.semantics in (QUALITATIVE, EAGER):
            return Rows(t, v > node.args[1] if sign > 0 else v < node.args[1], t)
        return Rows(t, margin, margin)

    def _gt(self, node):
        return self._compare(node, 1)

    def _lt(self, node):
        return self._compare(node, -1)

    # Connectives
    def _not(self, node: Formula) -> Rows:
        x = self.rows(node.parts[0])
        if self.semantics == QUANTITATIVE:
            return Rows(x.t, -x.a)
        if self.semantics == ROSI:
            return Rows(x.t, -x.b, -x.a)
        return Rows(x.t, ~x.a, x.b)

    def _join(self, node: Formula, union: bool) -> Rows:
        x, y = (self.rows(p) for p in node.parts)
        if self.semantics == EAGER:
            return self._eager_join(x, y, union)
        t, i, j = _aligned(x, y)
        if self.semantics == QUALITATIVE:
            return Rows(t, x.a[i] | y.a[j] if union else x.a[i] & y.a[j])
        pick = np.maximum if union else np.minimum
        return Rows(t, pick(x.a[i], y.a[j]), pick(x.b[i], y.b[j]) if self.semantics == ROSI else None)

    def _eager_join(self, x: Rows, y: Rows, cut: bool) -> Rows:
        t = np.union1d(x.t, y.t)

        def spread(r: Rows):
            value, when, there = np.full(t.size, not cut), np.full(t.size, NEVER), np.zeros(t.size, bool)
            at = np.searchsorted(t, r.t)
            value[at], when[at], there[at] = r.a, r.b, True
            return value, when, there

        (vx, dx, hx), (vy, dy, hy) = spread(x), spread(y)
        cx, cy = (vx == cut) & (dx != NEVER), (vy == cut) & (dy != NEVER)
        value = np.where(cx | cy, cut, not cut)
        when = np.where(cx & cy, np.minimum(dx, dy), np.where(cx, dx, np.where(cy, dy, np.maximum(dx, dy))))
        keep = (hx & hy) | cx | cy
        return Rows(t[keep], value[keep], self._released(t[keep], when[keep]))

    def _and(self, node):
        return self._join(node, False)

    def _or(self, node):
        return self._join(node, True)

    def _implies(self, node):
        return self.rows(Formula.or_(Formula.not_(node.parts[0]), node.parts[1]))

    # Temporal operators
    def _bounds(self, node: Formula) -> tuple[int, int]:
        return micros(node.args[0]), micros(node.args[1])

    def _extreme(self, t, v, node, largest: bool) -> np.ndarray:
        start, end = self._bounds(node)
        empty = -INF if largest else INF
        if self.naive:
            pick = max if largest else min
            return np.array([pick((float(y) for s, y in zip(t, v, strict=True) if x + start <= s <= x + end), default=empty) for x in t])
        return kernels.extremes(v, *kernels.window(t, start, end), largest, empty)

    def close(self, t: np.ndarray, node: Formula) -> np.ndarray:
        """The first sample time at or after t + depth."""
        at = np.searchsorted(self.grid, t + node.depth, side="left")
        found = np.where(at < self.grid.size, self.grid[np.minimum(at, self.grid.size - 1)] if self.grid.size else 0, NEVER)
        if self.bases is not None:
            found = np.where(self.owner(found) == self.owner(t), found, NEVER)
        return np.where(t <= self.frontier(node), found, NEVER) if self.growing else found

    def _sweep(self, node: Formula, cut: bool) -> Rows:
        x = self.rows(node.parts[0])
        if self.semantics == QUALITATIVE:
            return Rows(x.t, self._extreme(x.t, x.a, node, cut) > 0 if cut else self._extreme(x.t, x.a, node, cut) >= 1)
        if self.semantics == QUANTITATIVE:
            return Rows(x.t, self._extreme(x.t, x.a, node, cut))
        if self.semantics == ROSI:
            low, high = self._extreme(x.t, x.a, node, cut), self._extreme(x.t, x.b, node, cut)
            open_ = self._open(node, x.t)
            return Rows(x.t, low if cut else np.where(open_, -INF, low), np.where(open_, INF, high) if cut else high)
        start, end = self._bounds(node)
        hit = (x.a == cut) & (x.b != NEVER)
        soonest = kernels.extremes(np.where(hit, x.b, NEVER), *kernels.window(x.t, start, end), False, NEVER)
        close = self.close(x.t, node)
        early = soonest != NEVER
        when = np.where(early & (x.b != NEVER), np.minimum(close, np.maximum(x.b, soonest)), close)
        return Rows(x.t, np.where(early, cut, not cut), self._released(x.t, when))

    def _eventually(self, node):
        return self._sweep(node, True)

    def _always(self, node):
        return self._sweep(node, False)

    def _until(self, node: Formula) -> Rows:
        x, y = (self.rows(p) for p in node.parts)
        start, end = self._bounds(node)
        start = 0 if self.ignore_start else start
        t, i, j = _aligned(x, y)
        if self.semantics == EAGER:
            value, when = kernels.eager_until(t, x.a[i], x.b[i], y.a[j], y.b[j], start, end, self.close(t, node))
            return Rows(t, value, self._released(t, when))

        def run(left, right):
            if self.naive:
                out = []
                for k, now in enumerate(t):
                    best, least = -INF, INF
                    for s, l, r in zip(t[k:], left[k:], right[k:], strict=True):
                        if s > now + end:
                            break
                        least = min(least, l)
                        best = max(best, min(r, least)) if s >= now + start else best
                    out.append(best)
                return np.array(out, dtype=np.float64)
            return kernels.until(t, left, right, start, end)

        if self.semantics == QUALITATIVE:
            return Rows(t, run(x.a[i].astype(np.float64), y.a[j].astype(np.float64)) > 0)
        low = run(x.a[i], y.a[j])
        if self.semantics == QUANTITATIVE:
            return Rows(t, low)
        open_ = self._open(node, t)
        return Rows(t, low, np.where(open_, INF, run(x.b[i], y.b[j])))


def synchronized(samples: dict[str, tuple[np.ndarray, np.ndarray]], strategy: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Each signal on the times of all, between its first and last sample: held or interpolated."""
    if strategy == "None" or len(samples) < 2:
        return samples
    grid = np.unique(np.concatenate([t for t, _ in samples.values()]))
    out = {}
    for name, (t, v) in samples.items():
        if not t.size:
            out[name] = (t, v)
            continue
        g = grid[(grid >= t[0]) & (grid <= t[-1])]
        at = np.searchsorted(t, g, side="right") - 1
        after = np.minimum(at + 1, t.size - 1)
        if strategy == "Linear":
            span = (t[after] - t[at]) / 1e6
            with np.errstate(invalid="ignore", divide="ignore"):
                between = v[at] + (v[after] - v[at]) * (((g - t[at]) / 1e6) / span)
            out[name] = (g, np.where(t[at] == g, v[at], between))
        else:
            out[name] = (g, v[at])
    return out
