"""Kernels against their definitions by plain loops, and their cost."""

import random
import time

import numpy as np
import pytest

from vesper.operators import kernels
from vesper.operators.kernels import NEVER


def eager_until_by_rows(t, left, dl, right, dr, start, end, close):
    value, when = np.zeros(t.size, dtype=bool), np.full(t.size, NEVER)
    low, high = kernels.window(t, start, end)
    for i in range(t.size):
        held, sure_true, sure_false = 0, NEVER, 0
        for j in range(i, high[i]):
            if dl[j] != NEVER and not left[j]:
                sure_false = max(sure_false, dl[j], dr[j])
                break
            held = max(held, dl[j])
            if j >= low[i]:
                if right[j] and dr[j] != NEVER:
                    sure_true, sure_false = min(sure_true, max(held, dr[j])), NEVER
                else:
                    sure_false = max(sure_false, dr[j])
        else:
            sure_false = NEVER
        if sure_true != NEVER:
            value[i], when[i] = True, min(sure_true, close[i])
        else:
            when[i] = min(sure_false, close[i])
    return value, when


def test_eager_until_is_its_definition():
    rnd = np.random.default_rng(7)
    for _ in range(400):
        n = int(rnd.integers(0, 30))
        t = np.cumsum(rnd.integers(1, 4, n))
        left, right = rnd.random(n) < 0.8, rnd.random(n) < 0.2
        dl, dr = (np.where(rnd.random(n) < 0.1, NEVER, t + rnd.integers(0, 9, n)) for _ in range(2))
        start = int(rnd.integers(0, 4))
        end = start + int(rnd.integers(0, 12))
        close = np.where(rnd.random(n) < 0.3, NEVER, t + end + rnd.integers(0, 3, n))
        got = kernels.eager_until(t, left, dl, right, dr, start, end, close)
        want = eager_until_by_rows(t, left, dl, right, dr, start, end, close)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_whole_numbers_stay_exact():
    big = (1 << 61) + np.arange(9, dtype=np.int64)
    assert kernels.extremes(big, np.arange(9), np.full(9, 9), True, 0).tolist() == [int(big[-1])] * 9
    assert kernels.reached(big, big - 1, np.arange(9), np.arange(1, 10)).tolist() == (big - 1).tolist()


@pytest.mark.parametrize("end", [10, 20_000])
def test_eager_until_does_not_cost_the_window(end):
    n = 40_000
    t, d = np.arange(n), np.arange(n)
    left, right = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
    began = time.process_time()
    kernels.eager_until(t, left, d, right, d, 0, end, np.full(n, NEVER))
    assert time.process_time() - began < 2


def test_random_windows_are_their_rows():
    rnd = random.Random(9)
    values = np.array([rnd.uniform(-3, 3) for _ in range(50)])
    low = np.array([rnd.randrange(51) for _ in range(80)])
    high = np.array([min(50, x + rnd.randrange(-2, 20)) for x in low])
    for largest, pick, empty in ((True, max, -9.0), (False, min, 9.0)):
        got = kernels.extremes(values, low, high, largest, empty)
        assert got.tolist() == [pick(values[a:b], default=empty) for a, b in zip(low, high, strict=True)]


def test_whole_traces_come_in_runs_however_batches_are_cut():
    import pyarrow as pa

    from vesper.plans import planner

    rnd = random.Random(1)
    for _ in range(100):
        sizes = [rnd.randrange(1, 60) for _ in range(rnd.randrange(12))]
        trace = np.repeat(np.arange(len(sizes)), sizes)
        whole = pa.RecordBatch.from_pydict({"trace": pa.array(trace), "t": pa.array(np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, int))})
        parts, at = [], 0
        while at < whole.num_rows:
            parts.append(whole.slice(at, n := rnd.randrange(1, 20)))
            at += n
        got = list(planner._whole(iter(parts), ["trace"], rnd.choice([1, 10, 50]), 1 << 62))
        assert [x for batch, _ in got for x in batch.column("trace").to_pylist()] == trace.tolist()
        assert [batch.column("trace")[int(s)].as_py() for batch, starts in got for s in starts] == list(range(len(sizes)))
