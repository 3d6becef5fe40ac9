"""A streaming signals table to a stream of emissions, by arbitrary state per trace; and the emission log of a table.

State is an Online monitor's samples, bounded by the formula's depth; late samples are dropped by signal. Delayed
and eager verdicts are each given once; an interval is given when it first stands and when it narrows.

An emission log has every emission as it came: the time of the sample that brought it (emitted_at) and its number in its
trace (seq); sources.signals.latest and nested read it. For a table without an order of arrival, samples come by time, and the log of delayed
verdicts (and of eager ones over one signal) is the planner's verdicts joined, by windows, with the times at which they became
final. Else it is made sample by sample by the streaming state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators import sync
from ..operators.trace import EAGER, QUALITATIVE, ROSI
from ..plans import planner
from ..plans.formula import Formula, margins, micros, normalize
from .online import Online


def _columns(semantics: str) -> str:
    return "lo double, hi double" if semantics == ROSI else "value boolean" if semantics in (EAGER, QUALITATIVE) else "value double"


def _in_order(signals: DataFrame) -> list[str]:
    """By arrival, or else by time; a variable's change ("$" before its name) is before samples of its time."""
    return ["arrival_seq"] if "arrival_seq" in signals.columns else ["t", "signal"]


def _emissions(monitor: Online, rows: pd.DataFrame, trace, seq: int) -> list[tuple]:
    """The log of what each of the rows brings, after ``seq`` earlier emissions."""
    out = []
    for signal, x, t in zip(rows["signal"], rows["value"], rows["t"], strict=True):
        if monitor.add(signal, x, int(t)):
            for o in monitor.emit(changes=True):
                seq += 1
                out.append((trace, int(t), seq, *o))
    return out


def reaches(formula: Formula) -> dict[str | None, int]:
    """How far past t each signal must be known for the verdict at t; None: the latest of all signals, for constants."""
    found: dict[str | None, int] = {}

    def go(node: Formula, above: int) -> None:
        if not node.parts:
            for name in node.bases() or [None]:
                found[name] = max(found.get(name, 0), above)
        for p in node.parts:
            go(p, above + (micros(node.args[1]) if node.kind in ("always", "eventually", "until") else 0))

    go(normalize(formula), 0)
    return found


def _log_by_time(signals: DataFrame, formula: Formula, semantics: str, synchronization: str) -> DataFrame:
    """The log of a table whose samples come by time: a verdict comes with the first sample that makes it final."""
    rows, names = sync.drop_late(signals), formula.bases()
    seq = F.row_number().over(Window.partitionBy("trace").orderBy("t")).cast("long").alias("seq")
    verdicts = planner.verdicts(rows, formula, semantics, synchronization)
    if semantics == EAGER:
        return verdicts.select("trace", F.col("decided_at").alias("emitted_at"), seq, "t", "value")
    so_far = Window.partitionBy("trace").orderBy("t", "signal").rowsBetween(Window.unboundedPreceding, 0)
    known = [F.max(F.when(F.col("signal") == n, F.col("t")) if n is not None else F.col("t")).over(so_far) - d for n, d in reaches(formula).items()]
    rows = (rows.where(F.col("signal").isin(*names)) if names else rows).select("trace", "t", F.array_min(F.array(*known)).alias("upto"), F.forall(F.array(*known), lambda x: x.isNotNull()).alias("all"))
    comes = rows.where("all").groupBy("trace", "upto").agg(F.min("t").alias("emitted_at"))
    both = verdicts.select("trace", F.col("t").alias("upto"), F.lit(None).cast("long").alias("emitted_at"), "t", "value").unionByName(comes, allowMissingColumns=True)
    # From the latest back, so that the frame only grows; of equal times the sample is first.
    back = Window.partitionBy("trace").orderBy(F.desc("upto"), F.col("t").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("emitted_at", F.last("emitted_at", ignorenulls=True).over(back)).where("t is not null and emitted_at is not null")
    return met.select("trace", "emitted_at", seq, "t", "value")


def emission_log(signals: DataFrame, formula: Formula, semantics: str, synchronization: str) -> DataFrame:
    """(trace, emitted_at, seq, t, value or lo, hi) of a signals table, as its samples come by arrival_seq or time."""
    if "arrival_seq" not in signals.columns and semantics != ROSI and (semantics != EAGER or len(formula.bases()) == 1):
        return _log_by_time(signals, formula, semantics, synchronization)
    kind, order = signals.schema["trace"].dataType.simpleString(), _in_order(signals)
    schema = f"trace {kind}, emitted_at long, seq long, t long, {_columns(semantics)}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = _emissions(Online(formula, semantics, synchronization), rows.sort_values(order, kind="stable"), rows["trace"].iloc[0], 0)
        return pd.DataFrame(made, columns=names)

    return signals.where("trace is not null and signal is not null and t is not null").groupBy("trace").applyInPandas(run, schema)


#: The state of a trace: kept samples, each signal's last time, the last final verdict, emissions so far, late samples so far, variables.
STATE = "samples map<string,array<struct<t:bigint,v:double>>>, last map<string,bigint>, done bigint, seq bigint, late bigint, variables map<string,double>"


def monitor_stream(
    signals: DataFrame,
    formula: Formula,
    semantics: str,
    synchronization: str,
    log: bool = False,
    variables: dict[str, float] | None = None,
    changes: DataFrame | None = None,
    expire: str | None = None,
) -> DataFrame:
    """(trace, t, value) or (trace, t, lo, hi) of signals (trace, signal, t, value[, arrival_seq]) as they come; or their emission log.

    Intervals are an update stream (write it in update mode): a row is a time's interval from now on. All else is appended.
    ``changes``: a stream (trace, name, t, value[, arrival_seq]) of new values of variables, each for the samples of its trace that come after it;
    ``variables``: their values before. Samples that need a variable without a value are not evaluated.
    ``expire``: how far behind the latest sample of all (the watermark) a trace's last one may be, as an interval such as "1 day";
    a trace further behind loses its state, and older samples are dropped and counted by Spark as dropped by the watermark. Samples that
    are late for their own signal are counted in the state, which ``states`` reads.
    """
    kind, order = signals.schema["trace"].dataType.simpleString(), _in_order(signals)
    mode = "update" if semantics == ROSI and not log else "append"
    schema = f"trace {kind}, " + "emitted_at long, seq long, " * log + f"t long, {_columns(semantics)}"
    names = [x.split()[0] for x in schema.split(", ")]
    known = {k: float(v) for k, v in (variables or {}).items()}
    formula = formula if changes is not None else formula.bound(known)
    if changes is None and formula.variables():
        raise ValueError(f"Variable '{formula.variables()[0]}' not found in context")
    formula = margins(formula)
    needed = {}
    for n in formula.signals():
        if "-$" in n:
            needed.setdefault(n.split("-$")[0], []).append(n.split("-$")[1])

    def take(monitor: Online, values: dict[str, float], signal: str, x: float, t: int) -> bool | None:
        """Whether a sample was taken; None if it is none."""
        if signal.startswith("$"):
            values[signal[1:]] = x
            return None
        for v in needed.get(signal, ()):
            if v in values:
                monitor.add(f"{signal}-${v}", x - values[v], t)
        return monitor.add(signal, x, t)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        monitor, seq, late, values = Online(formula, semantics, synchronization), 0, 0, dict(known)
        if state.exists:
            samples, last, done, seq, late, values = state.get
            monitor.restore(({k: [tuple(x) for x in v] for k, v in samples.items()}, dict(last), done))
        rows, out = pd.concat(list(frames)).sort_values(order, kind="stable"), []
        for signal, x, t in zip(rows["signal"], rows["value"], rows["t"], strict=True):
            taken = take(monitor, values, signal, x, int(t))
            late += taken is False
            if taken and log:
                for o in monitor.emit(changes=True):
                    seq += 1
                    out.append((key[0], int(t), seq, *o))
        if not log:
            out = [(key[0], *o) for o in monitor.emit(changes=True)]
            seq += len(out)
        state.update((*monitor.state(), seq, late, values))
        if expire is not None and monitor.last:
            state.setTimeoutTimestamp(max(max(monitor.last.values()) // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=names)

    there = signals.where("trace is not null and signal is not null and t is not null")
    if changes is not None:
        steps = changes.where("trace is not null and name is not null and t is not null").withColumn("signal", F.concat(F.lit("$"), F.regexp_replace("name", "^[$]", "")))
        columns = ["trace", "signal", "t", "value", *[c for c in order if c == "arrival_seq"]]
        there = there.select(*columns).unionByName(steps.select(*columns))
    timeout = GroupStateTimeout.NoTimeout
    if expire is not None:
        there, timeout = there.withColumn("_time", F.timestamp_micros("t")).withWatermark("_time", expire), GroupStateTimeout.EventTimeTimeout
    return there.groupBy("trace").applyInPandasWithState(run, schema, STATE, mode, timeout)


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(trace, samples, late, seq) of the traces that a stream with this checkpoint has state of."""
    state = F.col("value.groupState")
    kept = F.aggregate(F.map_values(state["samples"]), F.lit(0), lambda n, s: n + F.size(s))
    return spark.read.format("statestore").load(checkpoint).select(F.col("key.trace").alias("trace"), kept.alias("samples"), state["late"].alias("late"), state["seq"].alias("seq"))
