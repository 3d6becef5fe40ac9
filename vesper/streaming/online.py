"""Verdicts as samples come in, for one trace: what the local monitor and the streaming processor share.

State is the samples that open verdicts can still need: those after the last final verdict, and one before them
per signal for holding and interpolation. So it is bounded by the formula's depth, whatever the trace's length. Delayed verdicts
come from incremental nodes over these samples, at amortized constant work a sample; a sample that is earlier than another signal's
changes what was held between, so the nodes are filled anew from the kept samples. Eager verdicts and intervals
are evaluated over the kept samples.
"""

from __future__ import annotations

import sys
from collections import deque

import numpy as np

from ..operators.kernels import NEVER
from ..operators.trace import EAGER, QUALITATIVE, ROSI, Evaluator, synchronized
from ..plans.formula import Formula, normalize
from .incremental import Aligner, Delayed


class Online:
    def __init__(self, formula: Formula, semantics: str, synchronization: str = "ZeroOrderHold", naive: bool = False):
        self.formula, self.semantics, self.naive = normalize(formula), semantics, naive
        self.synchronization = synchronization if len(formula.signals()) > 1 else "None"
        self.names = self.formula.signals()
        if self.formula.derived():
            raise ValueError("Expressions over signals are for tables")
        self.reset()

    def reset(self) -> None:
        self.samples: dict[str, deque[tuple[int, float]]] = {n: deque() for n in self.names}
        self.last: dict[str, int] = {}
        #: Verdicts up to this time have been given for good.
        self.done = -1
        self.found: list[tuple] = []
        #: What the last sample made known of its signal: (time, value, the verdicts that it made final).
        self.steps: list[tuple[int, float, list[tuple]]] = []
        #: Open intervals as they were given last.
        self.given = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self._fill()

    def _fill(self) -> None:
        """Incremental nodes as the kept samples make them."""
        self.nodes = None if self.naive or self.semantics in (EAGER, ROSI) else Delayed(self.formula, self.semantics)
        self.aligner, self.found = Aligner(self.names, self.synchronization), []
        for t, n, v in sorted((t, n, v) for n, s in self.samples.items() for t, v in s):
            self._feed(n, v, t)

    def _feed(self, signal: str, value: float, t: int) -> None:
        self.steps = []
        for u, v in self.aligner.rows(signal, value, t):
            made = self.nodes.feed(signal, v, u, t) if self.nodes is not None else []
            made = [(w, x if self.semantics == QUALITATIVE else x + 0.0) for w, x in made if w > self.done]
            self.steps.append((u, v, made))
            self.found += made

    def state(self) -> tuple:
        return {n: list(s) for n, s in self.samples.items()}, self.last, self.done

    def restore(self, state: tuple) -> None:
        samples, self.last, self.done = state
        self.samples = {n: deque(s) for n, s in samples.items()}
        self._fill()
        if self.semantics == ROSI and self.size():
            done = self.done
            self.emit(changes=True)  # what the kept samples say was given before
            self.done = done

    def size(self) -> int:
        return sum(map(len, self.samples.values()))

    def bytes(self) -> int:
        """Bytes of what is held: samples, and the incremental nodes' rows."""
        seen: set[int] = set()

        def of(x) -> int:
            if id(x) in seen:
                return 0
            seen.add(id(x))
            parts = x.items() if isinstance(x, dict) else x if isinstance(x, (list, tuple, deque)) else vars(x).values() if type(x).__module__ == Delayed.__module__ else ()
            return sys.getsizeof(x) + sum(map(of, parts))

        return sum(map(of, (self.samples, self.last, self.aligner.waiting, self.aligner.last))) + (of(self.nodes.state) if self.nodes is not None else 0)

    def add(self, signal: str, value: float, t: int) -> bool:
        """Keeps a sample, unless its signal has reached its time already."""
        if t <= self.last.get(signal, -1) or value is None or np.isnan(value):
            return False
        self.last[signal] = t
        if signal in self.samples or not self.names:
            self.samples.setdefault(signal, deque()).append((t, float(value)))
            if self.nodes is not None and t < self.nodes.now and (self.aligner.aligned or self.nodes.constant):
                self.steps = [(u, v, []) for u, v in self.aligner.rows(signal, float(value), t)]
                steps, self.steps = self.steps, []
                self._fill()
                self.steps = [*steps[:-1], (*steps[-1][:2], self.found)]
            else:
                self._feed(signal, float(value), t)
        else:
            self.steps = [(t, float(value), [])]
        return True

    def emit(self, changes: bool = False) -> list[tuple]:
        """(t, value) or (t, lo, hi) that the samples so far decide and that have not been given yet, in order of time.

        Open intervals are given again each time; with ``changes`` only those that narrowed since.
        """
        if self.nodes is not None:
            out, self.found = self.found, []
            if out:
                self.done = out[-1][0]
                self.prune()
            return out
        arrays = {n: (np.array([t for t, _ in s], dtype=np.int64), np.array([v for _, v in s], dtype=np.float64)) for n, s in self.samples.items()}
        made = Evaluator(synchronized(arrays, self.synchronization), self.semantics, self.naive, growing=True)
        rows, upto = made.rows(self.formula), made.frontier(self.formula)
        new = rows.t > self.done
        if self.semantics == ROSI:
            say, final = new, rows.t[new & (rows.t <= upto)]
            if changes:
                t, lo, hi = self.given
                at = np.minimum(np.searchsorted(t, rows.t), max(t.size - 1, 0))
                say = new & ~((t[at] == rows.t) & (lo[at] == rows.a) & (hi[at] == rows.b)) if t.size else new
                self.given = rows.t[new], rows.a[new], rows.b[new]
            out = list(zip(rows.t[say].tolist(), (rows.a[say] + 0.0).tolist(), (rows.b[say] + 0.0).tolist(), strict=True))
        else:
            if self.semantics == EAGER:
                when = np.maximum.accumulate(np.where(new, rows.b, -1)) if rows.t.size else rows.b
                keep = new & (when != NEVER)
            else:
                keep = new & (rows.t <= upto)
            value = rows.a[keep] if self.semantics in (EAGER, QUALITATIVE) else rows.a[keep] + 0.0
            out = list(zip(rows.t[keep].tolist(), value.tolist(), strict=True))
            final = rows.t[keep]
        if final.size:
            self.done = int(final[-1])
            self.prune()
        return out

    def prune(self) -> None:
        for s in self.samples.values():
            while len(s) > 1 and s[1][0] <= self.done:
                s.popleft()
