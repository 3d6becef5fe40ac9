"""Incremental verdicts against the kept samples' evaluation, sample by sample; and their cost."""

import random
import time

import pytest

from tests.test_planner import formula
from vesper import Monitor, parse_stl
from vesper.plans.formula import normalize
from vesper.streaming.incremental import Window, _clamps
from vesper.streaming.online import Online


def arrivals(rnd, names, n, lag):
    """Samples by arrival: in order of time, but each signal ``lag`` steps behind the one before it."""
    rows = []
    for i, s in enumerate(names):
        t = 0
        for _ in range(n):
            t += rnd.choice([1, 1, 2, 5]) * 500_000
            rows.append((t + i * lag * 1_000_000, t, s, float(rnd.randint(-3, 3))))
    return [r[1:] for r in sorted(rows)]


@pytest.mark.parametrize("semantics", ["DelayedQuantitative", "DelayedQualitative"])
@pytest.mark.parametrize("synchronization", ["ZeroOrderHold", "Linear", "None"])
@pytest.mark.parametrize("lag", [0, 3])
def test_is_the_evaluation_of_all_samples(semantics, synchronization, lag):
    from vesper.operators.trace import Evaluator, synchronized
    import numpy as np

    rnd = random.Random(f"{semantics}{synchronization}{lag}")
    for names in ("x", "xy"):
        for k in range(40):
            f = formula(rnd, rnd.choice([1, 2, 3]), names)
            f = f & parse_stl("true") if k % 5 == 0 else f
            online, got, seen = Online(f, semantics, synchronization), [], {n: [] for n in normalize(f).signals()}
            for t, s, v in arrivals(rnd, names, 25, lag):
                if online.add(s, v, t) and s in seen:
                    seen[s].append((t, v))
                got += online.emit()
                if rnd.random() < 0.05:
                    restored = Online(f, semantics, synchronization)
                    restored.restore(online.state())
                    restored.emit()
                    online = restored
            assert [t for t, _ in got] == sorted({t for t, _ in got})
            if lag and synchronization != "None":
                continue  # what was given before a lagging sample stays
            arrays = {n: (np.array([t for t, _ in s], dtype=np.int64), np.array([v for _, v in s])) for n, s in seen.items()}
            made = Evaluator(synchronized(arrays, online.synchronization), semantics, growing=True)
            found = made.rows(normalize(f))
            upto = made.frontier(normalize(f))
            assert got == [(t, v) for t, v in zip(found.t.tolist(), found.a.tolist(), strict=True) if t <= upto], str(f)


@pytest.mark.parametrize("synchronization", ["ZeroOrderHold", "Linear"])
def test_lagging_signals_give_what_the_kept_samples_give(synchronization):
    rnd = random.Random(synchronization)
    for _ in range(40):
        f = formula(rnd, 2, "xy")
        a, b = Online(f, "DelayedQuantitative", synchronization), Online(f, "DelayedQuantitative", synchronization, naive=True)
        for t, s, v in arrivals(rnd, "xy", 25, 3):
            assert a.add(s, v, t) == b.add(s, v, t) and a.emit() == b.emit(), str(f)


def test_windows_fold_in_order():
    rnd, rows = random.Random(5), []
    window = Window(_clamps, (float("-inf"), float("inf")))
    for t in range(300):
        lo = rnd.randint(-5, 5)
        row = (lo, lo + rnd.randint(0, 4))
        window.push(t, row)
        rows.append((t, row))
        start = t - rnd.choice([0, 3, 10])
        window.drop(start)
        rows = [r for r in rows if r[0] >= start]
        u = float("-inf")
        for _, (low, high) in reversed(rows):
            u = min(high, max(low, u))
        assert window.value()[0] == u and len(window) == len(rows)


@pytest.mark.parametrize("text", ["G[0,{b}](x > 0)", "F[{a},{b}](x > 0)", "x > -2 U[0,{b}] x > 1", "G[0,{b}](F[0,{a}](x > 0))"])
def test_cost_of_a_sample_does_not_grow_with_the_window(text):
    def seconds(b):
        monitor, n = Monitor(text.format(a=b // 2, b=b)), 6000
        rnd = random.Random(b)
        values = [rnd.uniform(-3, 3) for _ in range(n)]
        best = float("inf")
        for _ in range(3):
            monitor.reset()
            began = time.process_time()
            for t, v in enumerate(values):
                monitor.update("x", v, t)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(2000) < 3 * seconds(20)


def test_bytes_are_of_the_state():
    small, large = Monitor("G[0,10](x > 0)"), Monitor("G[0,1000](x > 0)")
    for t in range(2000):
        small.update("x", t % 7, t)
        large.update("x", t % 7, t)
    assert 0 < small.total_bytes() < large.total_bytes() / 20
    was = large.total_bytes()
    for t in range(2000, 6000):
        large.update("x", t % 7, t)
    assert large.total_bytes() < 2 * was
