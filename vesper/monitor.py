"""The monitor: one formula with its options, over DataFrames, streams, or samples given one by one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators import sync
from .operators.trace import EAGER, QUALITATIVE, QUANTITATIVE, ROSI, SEMANTICS
from .plans import planner
from .plans.formula import Formula, margins, micros, number
from .plans.parser import parse_stl
from .streaming.online import Online


class Variables:
    """Named thresholds that can change between samples; a monitor reads them when a sample comes."""

    def __init__(self, values: dict[str, float] | None = None):
        self._values = {k.removeprefix("$"): float(v) for k, v in (values or {}).items()}

    def set(self, name: str, value: float) -> None:
        self._values[name.removeprefix("$")] = float(value)

    def get(self, name: str) -> float | None:
        return self._values.get(name.removeprefix("$"))

    def contains(self, name: str) -> bool:
        return name.removeprefix("$") in self._values

    def names(self) -> list[str]:
        return sorted(self._values)

    def remove(self, name: str) -> float | None:
        return self._values.pop(name.removeprefix("$"), None)

    def clear(self) -> None:
        self._values.clear()

    def is_empty(self) -> bool:
        return not self._values

    def __len__(self) -> int:
        return len(self._values)

    def __iter__(self) -> Iterator[tuple[str, float]]:
        return iter(sorted(self._values.items()))

    def __str__(self) -> str:
        return "Variables(" + ", ".join(f"${k} = {number(v)}" for k, v in self) + ")"

    __repr__ = __str__


# Time suffixes in seconds.
UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0}


def step(signal: str, value: float, at: float | str) -> tuple[str, float, float]:
    """A sample for Monitor.update; times are seconds or texts such as "10ms"."""
    if isinstance(at, str):
        unit = next((u for u in ("ns", "us", "ms", "s") if at.endswith(u)), None)
        if unit is None:
            raise ValueError(f"Unknown time unit in '{at}'")
        at = float(at.removesuffix(unit)) * UNITS[unit]
    return signal, float(value), float(at)


@dataclass
class SyncStep:
    """A sample as the evaluator saw it (one that was given, or one that was held or interpolated at another signal's time), and the verdicts that it brought."""

    signal: str
    timestamp: float
    value: float
    outputs: list[tuple] = field(default_factory=list)


def _shown(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


@dataclass
class MonitorOutput:
    input_signal: str
    input_timestamp: float
    input_value: float
    evaluations: list[SyncStep]

    def raw_outputs(self) -> list[tuple]:
        """(t, value) in the order they were given, refinements included; t in seconds."""
        return [o for e in self.evaluations for o in e.outputs]

    all_raw_outputs = raw_outputs

    def verdicts(self) -> list[tuple]:
        """The last value for each time, by time."""
        return sorted(dict(self.raw_outputs()).items())

    into_verdicts = finalize = verdicts

    def total_raw_outputs(self) -> int:
        return len(self.raw_outputs())

    total_outputs = total_raw_outputs

    def has_verdicts(self) -> bool:
        return bool(self.raw_outputs())

    has_outputs = has_verdicts

    def is_pending(self) -> bool:
        return not self.has_verdicts()

    is_empty = is_pending

    def verdict_at(self, timestamp: float):
        return dict(self.raw_outputs()).get(float(timestamp))

    def latest_verdict(self):
        """The one that was given last."""
        return raw[-1] if (raw := self.raw_outputs()) else None

    def sync_evaluations(self) -> list[SyncStep]:
        return self.evaluations

    def to_dict(self) -> dict:
        steps = [
            {"sync_step_signal": e.signal, "sync_step_timestamp": e.timestamp, "sync_step_value": e.value, "outputs": [{"timestamp": t, "value": v} for t, v in e.outputs]}
            for e in self.evaluations
        ]
        return {"input_signal": self.input_signal, "input_timestamp": self.input_timestamp, "input_value": self.input_value, "evaluations": steps}

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.raw_outputs())

    def __str__(self) -> str:
        return "\n".join(f"t={number(t)}s: {_shown(v)}" for t, v in self.verdicts()) or "No verdicts available"

    __repr__ = __str__


class Monitor:
    def __init__(
        self,
        formula: Formula | str,
        semantics: str = QUANTITATIVE,
        algorithm: str = "Incremental",
        synchronization: str = "ZeroOrderHold",
        variables: Variables | dict | None = None,
    ):
        if formula is None:
            raise ValueError("Formula definition is required")
        if algorithm not in ("Incremental", "Naive"):
            raise ValueError("Invalid algorithm. Use 'Incremental' or 'Naive'")
        if synchronization not in sync.STRATEGIES:
            raise ValueError("Invalid synchronization. Use 'ZeroOrderHold', 'Linear', or 'None'")
        if semantics not in SEMANTICS:
            raise ValueError("Invalid semantics. Use 'DelayedQualitative', 'EagerQualitative', 'DelayedQuantitative', or 'Rosi'")
        self.formula = parse_stl(formula) if isinstance(formula, str) else formula
        self.variables = variables if isinstance(variables, Variables) else Variables(variables)
        if algorithm == "Naive":
            if semantics in (EAGER, ROSI):
                raise ValueError("Naive algorithm does not support RoSI/Eager evaluation")
            if self.formula.variables():
                raise ValueError("Naive algorithm does not support variables")
        self.semantics, self.algorithm = semantics, algorithm
        self.synchronization = synchronization if len(self.formula.signals()) > 1 else "None"
        self._chosen = synchronization
        self.reset()

    # Over DataFrames
    def evaluate(self, signals: DataFrame, **options) -> DataFrame:
        """Verdicts of a signals table (see planner.verdicts for its columns and the options)."""
        if self.algorithm == "Naive":
            options["strategy"] = "naive"
        return planner.verdicts(signals, self.formula, self.semantics, self.synchronization, dict(self.variables), **options)

    def stream(self, signals: DataFrame, log: bool = False, changes: DataFrame | None = None, expire: str | None = None) -> DataFrame:
        """The emissions of a streaming signals table (see processor.monitor_stream); as a log, with the time and number of each."""
        from .streaming import processor

        return processor.monitor_stream(signals, self.formula, self.semantics, self.synchronization, log, dict(self.variables), changes, expire)

    def emissions(self, signals: DataFrame) -> DataFrame:
        """The emission log of a signals table: what ``update`` gives, sample by sample; of intervals, those that narrowed."""
        from .streaming import processor

        return processor.emission_log(signals, self.formula.bound(dict(self.variables)), self.semantics, self.synchronization)

    # One by one
    def reset(self) -> None:
        """Forgets all samples; options and variables stay."""
        if self.formula.derived():
            return  # for tables only
        self._pseudo = [n for n in self.formula.walk() if n.kind in ("gt_var", "lt_var")]
        self._online = Online(margins(self.formula), self.semantics, self.synchronization, self.algorithm == "Naive")

    def update(self, signal: str, value: float, timestamp: float) -> MonitorOutput:
        if timestamp < 0 or timestamp != timestamp:
            raise ValueError("Timestamps must be non-negative")
        if self.formula.derived():
            raise ValueError("Expressions over signals are for tables")
        t, made = micros(timestamp), []
        for variable in sorted({n.args[1] for n in self._pseudo if n.args[0] == signal}):
            limit = self.variables.get(variable)
            if limit is None:
                raise ValueError(f"Variable '{variable}' not found in context")
            self._online.add(f"{signal}-${variable}", value - limit, t)
        if self._online.add(signal, value, t):
            shown = lambda found: [(o[0] / 1e6, o[1] if len(o) == 2 else (o[1], o[2])) for o in found]
            steps, all_outputs = self._online.steps, shown(self._online.emit())
            made = [SyncStep(signal, u / 1e6, v, shown(own)) for u, v, own in steps]
            given = sum(len(s.outputs) for s in made)
            if given != len(all_outputs):  # eager verdicts, intervals, and what other signals brought: with the sample itself
                made = [SyncStep(s.signal, s.timestamp, s.value) for s in made]
                made[-1].outputs = all_outputs
            made[-1].timestamp, made[-1].value = timestamp, value
        return MonitorOutput(signal, timestamp, value, made)

    def update_batch(self, steps: dict[str, list[tuple[float, float]]]) -> MonitorOutput:
        """Samples by signal as (value, timestamp), taken by time and then by signal."""
        rows = sorted((t, s, v) for s, samples in steps.items() for v, t in samples)
        if not rows:
            raise ValueError("update_batch requires at least one step")
        made = [self.update(s, v, t) for t, s, v in rows]
        t, s, v = rows[-1]
        return MonitorOutput(s, t, v, [e for m in made for e in m.evaluations])

    # Configuration
    def get_signal_identifiers(self) -> set[str]:
        return set(self.formula.signals())

    def get_variables(self) -> Variables:
        return self.variables

    def get_specification(self) -> str:
        return str(self.formula)

    def get_algorithm(self) -> str:
        return self.algorithm

    def get_semantics(self) -> str:
        return self.semantics

    def get_synchronization_strategy(self) -> str:
        return self._chosen

    def get_temporal_depth(self) -> float:
        return self.formula.depth / 1e6

    def total_size(self) -> int:
        """Samples held."""
        return self._online.size()

    def total_bytes(self) -> int:
        """Bytes of the state: the samples held and the rows of open windows."""
        return self._online.bytes()

    def __str__(self) -> str:
        lines = ["STL Monitor Configuration:", f"  Specification: {self.formula}", f"  Algorithm: {self.algorithm}", f"  Semantics: {self.semantics}"]
        lines += [f"  Synchronization: {self.synchronization}", f"  Temporal Depth: {number(self.get_temporal_depth())}s"]
        if not self.variables.is_empty():
            lines += ["  Variables:", *[f"    ${k} = {number(v)}" for k, v in self.variables]]
        return "\n".join(lines)

    __repr__ = __str__


__all__ = ["EAGER", "QUALITATIVE", "QUANTITATIVE", "ROSI", "Monitor", "MonitorOutput", "Variables", "step"]
