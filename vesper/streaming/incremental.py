"""Delayed verdicts as samples come in time order, at amortized constant work a sample, whatever the windows' lengths.

Every distinct node of a formula keeps the rows that open windows still need, and turns new rows of its operands into new rows of its own:
a row of a window goes out once its operands are final up to the window's end. A window's fold is that of two stacks: rows
come to the back and go from the front, and each is folded twice at most. Least and greatest values fold so, and so does
until: u(t) = min(left, max(right, u of the next row)) clamps u between two numbers, and clamps make clamps.
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from collections.abc import Callable

from ..operators.trace import QUALITATIVE
from ..plans.formula import Formula, micros

Row = tuple[int, float]


class Window:
    """The fold, by an associative ``join``, of rows in a window whose ends only move on."""

    def __init__(self, join: Callable, empty):
        self.join, self.empty = join, empty
        self.front: list[tuple] = []  # (time, fold from here to the front's end), the earliest last
        self.back: list[tuple] = []
        self.total = empty

    def push(self, t: int, value) -> None:
        self.back.append((t, value))
        self.total = self.join(self.total, value)

    def drop(self, before: int) -> None:
        """Forgets the rows before a time."""
        front, back = self.front, self.back
        while True:
            if not front:
                if not back or back[0][0] >= before:
                    return
                fold = self.empty
                while back:
                    t, value = back.pop()
                    fold = self.join(value, fold)
                    front.append((t, fold))
                self.total = self.empty
            if front[-1][0] >= before:
                return
            front.pop()

    def value(self):
        return self.join(self.front[-1][1], self.total) if self.front else self.total

    def __len__(self) -> int:
        return len(self.front) + len(self.back)


def _clamps(f: tuple, g: tuple) -> tuple:
    """(least, most) of clamping by g and then by f."""
    (fl, fm), (gl, gm) = f, g
    return (fl if gl < fl else fm if gl > fm else gl), (fl if gm < fl else fm if gm > fm else gm)


class _Sweep:
    def __init__(self, node: Formula, low, high):
        self.start, self.end = micros(node.args[0]), micros(node.args[1])
        self.window = Window(max, low) if node.kind == "eventually" else Window(min, high)
        self.pending: deque[int] = deque()

    def _release(self, upto: int, out: list[Row]) -> None:
        pending, window = self.pending, self.window
        while pending and pending[0] + self.end <= upto:
            t = pending.popleft()
            window.drop(t + self.start)
            out.append((t, window.value()))

    def feed(self, operands: list) -> tuple[list[Row], int]:
        ((rows, final),) = operands
        out: list[Row] = []
        for u, v in rows:
            self._release(u - 1, out)
            self.window.push(u, v)
            self.pending.append(u)
        self._release(final, out)
        return out, final - self.end

    def __len__(self) -> int:
        return len(self.window) + len(self.pending)


class _Meet:
    """Rows of two operands at common times."""

    def __init__(self):
        self.left: deque[Row] = deque()
        self.right: deque[Row] = deque()

    def rows(self, operands: list) -> tuple[list[tuple], int]:
        (x, fx), (y, fy) = operands
        left, right, out = self.left, self.right, []
        left.extend(x)
        right.extend(y)
        while left and right:
            (t, a), (u, b) = left[0], right[0]
            if t <= u:
                left.popleft()
            if u <= t:
                right.popleft()
            if t == u:
                out.append((t, a, b))
        return out, min(fx, fy)

    def __len__(self) -> int:
        return len(self.left) + len(self.right)


class _Join(_Meet):
    def __init__(self, node: Formula, low, high):
        super().__init__()
        self.pick = max if node.kind == "or" else min

    def feed(self, operands: list) -> tuple[list[Row], int]:
        rows, final = self.rows(operands)
        return [(t, self.pick(a, b)) for t, a, b in rows], final


class _Until(_Meet):
    def __init__(self, node: Formula, low, high):
        super().__init__()
        self.start, self.end = micros(node.args[0]), micros(node.args[1])
        self.window, self.held = Window(_clamps, (low, high)), Window(min, high)
        self.before: deque[Row] = deque()  # left's rows that are not yet in the stretch before a window
        self.pending: deque[int] = deque()

    def _release(self, upto: int, out: list[Row]) -> None:
        pending = self.pending
        while pending and pending[0] + self.end <= upto:
            t = pending.popleft()
            begin = t + self.start
            self.window.drop(begin)
            while self.before and self.before[0][0] < begin:
                self.held.push(*self.before.popleft())
            self.held.drop(t)
            out.append((t, min(self.held.value(), self.window.value()[0])))

    def feed(self, operands: list) -> tuple[list[Row], int]:
        rows, final = self.rows(operands)
        out: list[Row] = []
        for u, left, right in rows:
            self._release(u - 1, out)
            self.window.push(u, (min(left, right), left))
            if self.start:
                self.before.append((u, left))
            self.pending.append(u)
        self._release(final, out)
        return out, final - self.end

    def __len__(self) -> int:
        return super().__len__() + len(self.window) + len(self.held) + len(self.before) + len(self.pending)


KINDS = {"always": _Sweep, "eventually": _Sweep, "until": _Until, "and": _Join, "or": _Join}


class Aligner:
    """Each signal on the times of all, as samples come: what a sample makes known of its own signal."""

    def __init__(self, names: list[str], synchronization: str):
        self.aligned, self.linear = synchronization != "None" and len(names) > 1, synchronization == "Linear"
        self.last: dict[str, Row] = {}
        #: Times of other signals that each signal has not reached.
        self.waiting: dict[str, list[int]] = {n: [] for n in names}

    def rows(self, signal: str, value: float, t: int) -> list[Row]:
        """The signal's values at others' times since its last sample (held or interpolated), and the sample."""
        was, out = self.last.get(signal), []
        self.last[signal] = (t, value)
        if self.aligned:
            waiting = self.waiting[signal]
            for g in waiting:
                if g < t and was:
                    out.append((g, was[1] + (value - was[1]) * (((g - was[0]) / 1e6) / ((t - was[0]) / 1e6)) if self.linear else was[1]))
            self.waiting[signal] = [g for g in waiting if g > t]
            for other, times in self.waiting.items():
                if other != signal and t > self.last.get(other, (-1,))[0] and (not times or t > times[-1]):
                    times.append(t)
                elif other != signal and t > self.last.get(other, (-1,))[0] and t not in times:
                    insort(times, t)
        out.append((t, value))
        return out


class Delayed:
    """A normalized formula's verdicts, as its signals' rows come in time order."""

    def __init__(self, formula: Formula, semantics: str):
        self.formula, self.truth = formula, semantics == QUALITATIVE
        self.low, self.high = (False, True) if self.truth else (float("-inf"), float("inf"))
        self.order = list(formula.walk())
        self.state = {n.key: KINDS[n.kind](n, self.low, self.high) for n in self.order if n.kind in KINDS}
        self.constant = any(n.kind in ("true", "false") for n in self.order)
        #: How far each signal is known, and the latest time of all.
        self.known: dict[str, int] = {}
        self.now = -1

    def feed(self, signal: str, value: float, t: int, now: int) -> list[Row]:
        """What a signal's row at t, which a sample at ``now`` made known, makes final."""
        new, self.now, self.known[signal] = now > self.now, max(self.now, now), t
        done: dict[int, tuple[list[Row], int]] = {}
        for node in self.order:
            match node.kind:
                case "true" | "false":
                    done[node.key] = [(now, self.high if node.kind == "true" else self.low)] if new else [], self.now
                case "gt" | "lt":
                    name, limit = node.args
                    if name != signal:
                        done[node.key] = [], self.known.get(name, -1)
                    elif self.truth:
                        done[node.key] = [(t, value > limit if node.kind == "gt" else value < limit)], t
                    else:
                        done[node.key] = [(t, value - limit if node.kind == "gt" else limit - value)], t
                case "not":
                    found, final = done[node.parts[0].key]
                    done[node.key] = [(u, not v if self.truth else -v) for u, v in found], final
                case _:
                    done[node.key] = self.state[node.key].feed([done[p.key] for p in node.parts])
        return done[self.formula.key][0]
