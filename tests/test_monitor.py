"""Golden verdicts per input step, by every semantics, with equivalent spellings."""

import random

import pytest

from vesper import Formula, Monitor, Variables, parse_stl
from vesper.plans import catalog

# Published inputs, formulas and the verdicts that come with each input.
S1 = [("x", v, t) for t, v in enumerate((5, 4, 6, 2, 5))]
S2 = [("x", v, t) for t, v in enumerate((1, 1, 1, 2, 3, 4, 0, 0, 0, 1, 2))]
S3 = [("x", v, t) for t, v in enumerate((0, 6, 1, 0, 8, 1, 7))]
S4 = [s for t, (x, y) in enumerate(zip((0, 6, 1, 3, 8, 1, 7), (4, 3, 6, 7, 2, 1, 0), strict=True)) for s in (("x", x, t), ("y", y, t))]
F1 = ("G[0,2](x > 3)", "!(F[0,2](x <= 3))", "!((true) U[0,2] (x <= 3))")
F2 = ("(G[0,2](x > 0)) U[0,6] (F[0,2](x > 3))",)
F3 = ("F[0,2](x > 5) && G[0,2](x > 0)", "((true) U[0,2] (x > 5)) && !(F[0,2](x <= 0))")
F5 = ("F[0,2](x > 5)", "(true) U[0,2] (x > 5)", "F[0,2](x > 5) && true")
F6 = ("G[0,5](x > 0) -> F[0,2](x > 3)", "!(F[0,5](x <= 0)) -> ((true) U[0,2](x > 3))")
F8 = ("G[0,2](x > 0) && y < 5", "!(F[0,2](x <= 0)) && y < 5")
T, F = True, False
# Keys: the input, as a time or (signal, time). Values: verdicts given with it.
QUANT = [
    (F1, S1, {2: {0: 1}, 3: {1: -1}, 4: {2: -1}}),
    (F2, S2, {8: {0: 1}, 9: {1: 1}, 10: {2: 1}}),
    (F3, S3, {2: {0: 0}, 3: {1: 0}, 4: {2: 0}, 5: {3: 0}, 6: {4: 1}}),
    (F5, S3, {2: {0: 1}, 3: {1: 1}, 4: {2: 3}, 5: {3: 3}, 6: {4: 3}}),
    (F6, S2, {5: {0: -1}, 6: {1: 0}, 7: {2: 0}, 8: {3: 1}, 9: {4: 1}, 10: {5: 1}}),
    (("!(x < 5) || false",), S3, {t: {t: v} for t, v in enumerate((-5, 1, -4, -5, 3, -4, 2))}),
    (F8, S4, {("x", 2): {0: 0}, ("x", 3): {1: 1}, ("x", 4): {2: -1}, ("x", 5): {3: -2}, ("x", 6): {4: 1}}),
]
EAGERLY = [
    (F1, S1, {2: {0: T}, 3: {1: F, 2: F, 3: F}}),
    (F2, S2, {5: dict.fromkeys(range(4), T), 6: {4: F, 5: F}, 8: {6: F}, 9: {7: F}, 10: {8: F}}),
    (F3, S3, {0: {0: F}, 3: {1: F, 2: F, 3: F}, 6: {4: T}}),
    (F5, S3, {1: {0: T, 1: T}, 4: {2: T, 3: T, 4: T}, 6: {5: T, 6: T}}),
    (F6, S2, {5: {0: F}, 6: dict.fromkeys(range(1, 7), T), 7: {7: T}, 8: {8: T}}),
    (F8, S4, {("x", 0): {0: F}, ("x", 3): {1: T, 2: F}, ("y", 3): {3: F}, ("x", 6): {4: T}}),
    (("x < -1 U[0,4] (x > -1)",), S3, {t: {t: F} for t in range(7)}),
    (("x < 8 U[0,4] (x > 5)",), S3, {1: {0: T, 1: T}, 4: {2: F, 3: F, 4: F}, 6: {5: T, 6: T}}),
]
CASES = [(text, signal, want, "DelayedQuantitative") for fs, signal, want in QUANT for text in fs]
CASES += [(text, signal, want, "EagerQualitative") for fs, signal, want in EAGERLY for text in fs]


@pytest.mark.parametrize(("text", "signal", "want", "semantics"), CASES)
def test_goldens_per_step(text, signal, want, semantics):
    monitor, got = Monitor(text, semantics), {}
    for s, v, t in signal:
        if out := monitor.update(s, v, t).raw_outputs():
            got[(s, t) if len({x[0] for x in signal}) > 1 else t] = {int(k): x for k, x in out}
    assert got == want


def test_boolean_golden():
    monitor = Monitor(F6[0], "DelayedQualitative")
    got = [monitor.update(*s).raw_outputs() for s in S2]
    assert [x for x in got if x] == [[(0.0, F)], [(1.0, T)], [(2.0, T)], [(3.0, T)], [(4.0, T)], [(5.0, T)]]


def test_sparse_times_and_until_by_hand():
    monitor = Monitor("F[0,2](x>3)")
    out = monitor.update_batch({"x": [(100, 0), (15, 1), (16, 2), (2, 5), (2, 10)]}).verdicts()
    assert out == [(0.0, 97.0), (1.0, 13.0), (2.0, 13.0), (5.0, -1.0)]
    monitor = Monitor("x<10 U[0,4] x>5", "DelayedQualitative")
    assert monitor.update_batch({"x": [(2, 0), (2, 2), (2, 4), (6, 6), (12, 8)]}).verdicts() == [(0.0, F), (2.0, T), (4.0, T)]


def test_intervals_narrow_and_close_on_the_delayed_value():
    monitor = Monitor("G[0,2](x>5)", "Rosi")
    inf = float("inf")
    assert monitor.update("x", 7, 0).raw_outputs() == [(0.0, (-inf, 2.0))]
    assert monitor.update("x", 4, 1).raw_outputs() == [(0.0, (-inf, -1.0)), (1.0, (-inf, -1.0))]
    rnd = random.Random(3)
    for _, formula in [*catalog.get_formulas([1, 3, 4, 7, 10, 13, 16]), (0, parse_stl(F6[0])), (0, parse_stl(F3[0]))]:
        rosi, delayed, seen = Monitor(formula, "Rosi"), Monitor(formula), {}
        for t in range(45):
            v = rnd.uniform(-2, 2)
            for k, (lo, hi) in rosi.update("x", v, t).raw_outputs():
                was = seen.get(k, (-inf, inf))
                assert was[0] <= lo <= hi <= was[1]
                seen[k] = (lo, hi)
            for k, x in delayed.update("x", v, t).raw_outputs():
                assert seen[k] == (x, x)


def test_state_does_not_grow_and_reset_replays():
    for text in ("G[0,10](x > 0)", "x > 0 U[0,10] x > 1", "F[0,5](G[0,5](x>0))"):
        monitor = Monitor(text)
        first = [monitor.update("x", t % 7 - 3, t).raw_outputs() for t in range(30)]
        size = monitor.total_size()
        for t in range(30, 300):
            monitor.update("x", t % 7 - 3, t)
        assert monitor.total_size() <= size + 1 and size < 15
        monitor.reset()
        assert [monitor.update("x", t % 7 - 3, t).raw_outputs() for t in range(30)] == first


@pytest.mark.parametrize("strategy", ["ZeroOrderHold", "Linear"])
def test_signals_that_alternate_meet_everywhere_between(strategy):
    monitor = Monitor("x > 0 and y > 0", synchronization=strategy)
    out = monitor.update_batch({"x": [(t, t) for t in range(0, 101, 2)], "y": [(t, t) for t in range(1, 100, 2)]}).verdicts()
    assert [t for t, _ in out] == [float(t) for t in range(1, 100)]


@pytest.mark.parametrize("strategy", ["ZeroOrderHold", "Linear"])
def test_steps_between_samples_are_in_the_output(strategy):
    monitor = Monitor("x > 0 and y < 150", synchronization=strategy)
    monitor.update("x", 1, 0)
    assert [o for o, _ in monitor.update("y", 1, 0).raw_outputs()] == [0.0]
    for t in (2, 4, 6, 8):
        assert [(e.timestamp, e.value) for e in monitor.update("x", 1, t).sync_evaluations()] == [(t, 1)]
    out = monitor.update("y", 11, 10)
    held = (1, 1, 1, 1) if strategy == "ZeroOrderHold" else (3, 5, 7, 9)
    assert [(e.signal, e.timestamp, e.value) for e in out.sync_evaluations()] == [*(("y", float(t), v) for t, v in zip((2, 4, 6, 8), held, strict=True)), ("y", 10, 11)]
    assert [[t for t, _ in e.outputs] for e in out.sync_evaluations()] == [[2.0], [4.0], [6.0], [8.0], []]
    assert [t for t, _ in out.raw_outputs()] == [2.0, 4.0, 6.0, 8.0]
    assert monitor.update("y", 5, 10).sync_evaluations() == []  # late
    rosi = Monitor("G[0,20](x > 0 and y < 150)", "Rosi", synchronization=strategy)
    counts = [len(rosi.update(s, 1.0, t).verdicts()) for s, t in (("x", 0), ("y", 0), ("x", 2), ("x", 4), ("x", 6), ("x", 8), ("y", 10))]
    assert counts == [0, 1, 1, 1, 1, 1, 5]


def test_variables_hold_for_later_samples():
    variables = Variables({"A": 5.0})
    monitor = Monitor("x > A", variables=variables)
    assert monitor.update("x", 7, 0).verdicts() == [(0.0, 2.0)]
    variables.set("$A", 6)
    assert monitor.update("x", 7, 1).verdicts() == [(1.0, 1.0)]
    variables.remove("A")
    with pytest.raises(ValueError, match="not found"):
        monitor.update("x", 7, 2)


def test_late_samples_are_dropped():
    monitor = Monitor("x > 0")
    monitor.update("x", 1, 5)
    assert monitor.update("x", 9, 5).is_pending() and monitor.update("x", 9, 4).is_pending()


def test_options_and_shapes():
    for bad, said in (({"semantics": "x"}, "semantics"), ({"algorithm": "x"}, "algorithm"), ({"synchronization": "x"}, "synchronization"), ({"algorithm": "Naive", "semantics": "Rosi"}, "Naive algorithm does not support"), ({"algorithm": "Naive", "semantics": "EagerQualitative"}, "Naive")):
        with pytest.raises(ValueError, match=said):
            Monitor("x > 0", **bad)
    with pytest.raises(ValueError, match="at least one step"):
        Monitor("x > 0").update_batch({"x": []})
    out = Monitor("x > 0").update("x", 2, 1)
    assert out.to_dict() == {"input_signal": "x", "input_timestamp": 1, "input_value": 2, "evaluations": [{"sync_step_signal": "x", "sync_step_timestamp": 1, "sync_step_value": 2, "outputs": [{"timestamp": 1.0, "value": 2.0}]}]}
    assert str(out) == "t=1s: 2.0" and out.verdict_at(1) == 2.0 and out.latest_verdict() == (1.0, 2.0)
    assert "G[0, 5](x > 1)" in str(Monitor("G[0,5](x>1)")) and Monitor("G[0,5](x>1)").get_temporal_depth() == 5.0


def test_naive_agrees():
    for fs, signal, _ in QUANT:
        a, b = Monitor(fs[0]), Monitor(fs[0], algorithm="Naive")
        assert [a.update(*s).raw_outputs() for s in signal] == [b.update(*s).raw_outputs() for s in signal]


def test_builders_are_shared_nodes():
    f = Formula.always(0, 2, Formula.gt("x", 3))
    assert f is parse_stl("G[0,2](x > 3)") and str(~f & f) == "(¬(G[0, 2](x > 3))) ∧ (G[0, 2](x > 3))"
