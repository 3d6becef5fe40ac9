"""Formula and signals to a verdict DataFrame.

One exchange on trace brings a trace's samples together as wide rows, a time each; every distinct node of the normalized
formula becomes one set of columns. Connectives are column algebra; G and F are forward RANGE frames, which
share the exchange and the sort, and cost as many steps a row as the frame has rows. Formulas with U, and those whose frames would have
more than FRAME_ROWS rows by the signals' density, go to the numpy kernel, whose cost doesn't grow with windows' lengths (the window
strategy can fold a frame's rows in order, if it is asked for); so does whatever asks for the kernel.

Long traces: with ``bucket`` seconds (at least the formula's depth), each (trace, bucket) is evaluated by itself, with
the samples up to a depth after it, by either strategy: delayed verdicts and intervals. Signals are aligned bucket by bucket too (see
sync), and what a bucket must know of its whole trace (where it ends) comes from a summary row per bucket, so one
trace with a third of all rows is spread over many tasks, whatever the synchronization. ``arrivals`` does the same for late samples.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import sync
from ..operators.kernels import NEVER
from ..operators.trace import EAGER, QUALITATIVE, QUANTITATIVE, ROSI, SEMANTICS, Evaluator
from .formula import Formula, expression_over, margins, micros, normalize

INF = float("inf")
#: Rows of frames beyond which the kernel is the cheaper way.
FRAME_ROWS = 16
#: Pieces of time (a power of two) in which a variable timeline without traces meets samples, and parts of each by trace.
PIECES, SALTS = 256, 4
TYPES = {QUANTITATIVE: "value double", QUALITATIVE: "value boolean", EAGER: "value boolean, decided_at long", ROSI: "lo double, hi double"}


@dataclass
class Node:
    """Columns of a node (robustness; truth; truth and decision time; ends of an interval), and whether the row is on its grid."""

    columns: tuple[Column, ...]
    member: Column


class Compiler:
    def __init__(self, table: DataFrame, names: list[str], semantics: str, ignore_start: bool, keys: tuple[str, ...], thresholds: dict[str, Column]):
        self.df, self.names, self.semantics, self.ignore_start = table, names, semantics, ignore_start
        self.over = Window.partitionBy(*keys)
        self.ordered = self.over.orderBy("t")
        self.thresholds = thresholds
        #: Columns of the whole trace's newest times, if rows are parts of traces.
        self.newest: dict[int, str] = {}
        self.nodes: dict[int, Node] = {}

    def compile(self, root: Formula) -> Node:
        for node in root.walk():
            made = getattr(self, "_" + node.kind)(node)
            if node.parts:  # a column per node, so that what is shared is computed once
                kept = []
                for i, c in enumerate(made.columns):
                    name = f"n{node.key}_{i}"
                    self.df = self.df.withColumn(name, F.when(made.member, c))
                    kept.append(F.col(name))
                made = Node(tuple(kept), made.member)
            self.nodes[node.key] = made
        return self.nodes[root.key]

    def parts(self, node: Formula) -> list[Node]:
        return [self.nodes[p.key] for p in node.parts]

    def _constant(self, truth: bool) -> Node:
        if self.semantics in (QUALITATIVE, EAGER):
            return Node((F.lit(truth), F.col("t"))[: 1 + (self.semantics == EAGER)], F.lit(True))
        value = F.lit(INF if truth else -INF)
        return Node((value, value)[: 1 + (self.semantics == ROSI)], F.lit(True))

    def _true(self, node):
        return self._constant(True)

    def _false(self, node):
        return self._constant(False)

    def _compare(self, node: Formula) -> Node:
        value = F.col(f"s{self.names.index(node.args[0])}")
        limit = F.lit(node.args[1]) if isinstance(node.args[1], float) else self.thresholds[node.args[1]]
        above = node.kind.startswith("gt")
        there = value.isNotNull() & limit.isNotNull()
        if self.semantics in (QUALITATIVE, EAGER):
            truth = value > limit if above else value < limit
            return Node((truth, F.col("t"))[: 1 + (self.semantics == EAGER)], there)
        margin = (value - limit if above else limit - value) + F.lit(0.0)
        return Node((margin, margin)[: 1 + (self.semantics == ROSI)], there)

    _gt = _lt = _gt_var = _lt_var = _compare

    def _not(self, node: Formula) -> Node:
        (x,) = self.parts(node)
        match self.semantics:
            case "DelayedQuantitative":
                return Node((-x.columns[0] + F.lit(0.0),), x.member)
            case "Rosi":
                return Node((-x.columns[1] + F.lit(0.0), -x.columns[0] + F.lit(0.0)), x.member)
        return Node((~x.columns[0], *x.columns[1:]), x.member)

    def _join(self, node: Formula, union: bool) -> Node:
        x, y = self.parts(node)
        both = x.member & y.member
        if self.semantics == EAGER:
            return self._eager_join(x, y, union)
        if self.semantics == QUALITATIVE:
            return Node((x.columns[0] | y.columns[0] if union else x.columns[0] & y.columns[0],), both)
        pick = F.greatest if union else F.least
        return Node(tuple(pick(a, b) for a, b in zip(x.columns, y.columns, strict=True)), both)

    def _and(self, node):
        return self._join(node, False)

    def _or(self, node):
        return self._join(node, True)

    def _released(self, when: Column, member: Column) -> Column:
        """In-order release: no row before those that come earlier; a row that is undecided holds all later ones."""
        so_far = F.max(F.when(member, F.coalesce(when, F.lit(NEVER)))).over(self.ordered.rowsBetween(Window.unboundedPreceding, 0))
        return F.when(so_far < NEVER, so_far)

    def _newest(self, node: Formula, member: Column) -> Column:
        """The last time of the whole trace at which the node's operands have rows."""
        return F.col(self.newest[node.key]) if self.newest else F.max(F.when(member, F.col("t"))).over(self.over)

    def _eager_join(self, x: Node, y: Node, cut: bool) -> Node:
        (vx, dx), (vy, dy) = x.columns, y.columns
        cx = x.member & dx.isNotNull() & (vx == F.lit(cut))
        cy = y.member & dy.isNotNull() & (vy == F.lit(cut))
        cx, cy = F.coalesce(cx, F.lit(False)), F.coalesce(cy, F.lit(False))
        value = F.when(cx | cy, F.lit(cut)).otherwise(F.lit(not cut))
        when = F.when(cx & cy, F.least(dx, dy)).when(cx, dx).when(cy, dy).when(dx.isNotNull() & dy.isNotNull(), F.greatest(dx, dy))
        member = (x.member & y.member) | cx | cy
        return Node((value, self._released(when, member)), member)

    def _sweep(self, node: Formula, cut: bool) -> Node:
        (x,) = self.parts(node)
        start, end = micros(node.args[0]), micros(node.args[1])
        frame = self.ordered.rangeBetween(start, end)
        pick = F.max if cut else F.min
        t = F.col("t")

        def extreme(column: Column, empty) -> Column:
            return F.coalesce(pick(F.when(x.member, column)).over(frame), F.lit(empty))

        if self.semantics == QUALITATIVE:
            return Node((extreme(x.columns[0], not cut),), x.member)
        empty = -INF if cut else INF
        if self.semantics == QUANTITATIVE:
            return Node((extreme(x.columns[0], empty),), x.member)
        if self.semantics == ROSI:
            lo, hi = (extreme(c, empty) for c in x.columns)
            still_open = t + F.lit(node.depth) > self._newest(node, x.member)
            return Node((lo, F.when(still_open, F.lit(INF)).otherwise(hi)) if cut else (F.when(still_open, F.lit(-INF)).otherwise(lo), hi), x.member)
        value, when = x.columns
        soonest = F.min(F.when(x.member & when.isNotNull() & (value == F.lit(cut)), when)).over(frame)
        close = F.min("t").over(self.ordered.rangeBetween(node.depth, Window.unboundedFollowing))
        decided = F.when(soonest.isNotNull() & when.isNotNull(), F.least(close, F.greatest(when, soonest))).otherwise(close)
        return Node((F.when(soonest.isNotNull(), F.lit(cut)).otherwise(F.lit(not cut)), self._released(decided, x.member)), x.member)

    def _eventually(self, node):
        return self._sweep(node, True)

    def _always(self, node):
        return self._sweep(node, False)

    def _until(self, node: Formula) -> Node:
        x, y = self.parts(node)
        start, end = (0 if self.ignore_start else micros(node.args[0])), micros(node.args[1])
        both, t = x.member & y.member, F.col("t")
        truth = self.semantics == QUALITATIVE

        def fold(left: Column, right: Column) -> Column:
            rows = F.collect_list(F.when(both, F.struct(t.alias("t"), left.alias("l"), right.alias("r")))).over(self.ordered.rangeBetween(0, end))
            name = f"u{node.key}_{len(self.df.columns)}"
            self.df = self.df.withColumn(name, rows)

            def step(acc, row):
                least = acc["least"] & row["l"] if truth else F.least(acc["least"], row["l"])
                reach = least & row["r"] if truth else F.least(least, row["r"])
                best = acc["best"] | reach if truth else F.greatest(acc["best"], reach)
                return F.struct(F.when(row["t"] >= t + F.lit(start), best).otherwise(acc["best"]).alias("best"), least.alias("least"))

            first = F.struct(F.lit(False if truth else -INF).alias("best"), F.lit(True if truth else INF).alias("least"))
            return F.aggregate(F.col(name), first, step)["best"]

        found = tuple(fold(a, b) for a, b in zip(x.columns, y.columns, strict=True))
        if self.semantics == ROSI:
            found = (found[0], F.when(t + F.lit(node.depth) > self._newest(node, both), F.lit(INF)).otherwise(found[1]))
        return Node(found, both)


def _with_timeline(table: DataFrame, rows: DataFrame, formula: Formula, timeline: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """The table with a column per free variable: its last value at or before a row's time, null before the first."""
    names = formula.variables()
    if not names:
        return table, {}
    if timeline is None:
        raise ValueError(f"Variable '{names[0]}' not found in context")
    timeline = timeline.where(F.col("name").isin(*names))
    if "trace" in timeline.columns:
        steps = timeline.groupBy("trace", "t").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"v{i}") for i, n in enumerate(names)])
        past = Window.partitionBy("trace").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        merged = table.withColumn("_row", F.lit(True)).unionByName(steps, allowMissingColumns=True)
        merged = merged.groupBy("trace", "t").agg(*[F.max(c).alias(c) for c in merged.columns if c not in ("trace", "t")])
        merged = merged.select(*[c for c in merged.columns if not (c[0] == "v" and c[1:].isdigit())], *[F.last(f"v{i}", ignorenulls=True).over(past).alias(f"v{i}") for i in range(len(names))])
        return merged.where("_row").drop("_row"), {n: F.col(f"v{i}") for i, n in enumerate(names)}
    # Steps and samples meet by pieces of time with about as many rows each; what held before a piece is carried to it.
    steps = timeline.groupBy("t").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"v{i}") for i, n in enumerate(names)])
    bounds = _bounds(rows.select("t").union(timeline.select("t")))
    steps = _with_piece(steps, bounds)
    last = [F.max_by(F.struct(f"v{i}"), F.when(F.col(f"v{i}").isNotNull(), F.col("t")))[f"v{i}"].alias(f"b{i}") for i in range(len(names))]
    sums = steps.groupBy("_piece").agg(*last)
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # over PIECES rows at most
    every = timeline.sparkSession.range(PIECES).select(F.col("id").cast("int").alias("_piece")).join(sums, "_piece", "left")
    carried = every.select("_piece", *[F.last(f"b{i}", ignorenulls=True).over(earlier).alias(f"b{i}") for i in range(len(names))])
    salted = _with_piece(table, bounds).withColumns({"_salt": F.pmod(F.hash("trace"), F.lit(SALTS)), "_row": F.lit(1)})
    steps = steps.withColumns({"_salt": F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), "_row": F.lit(0)})
    past = Window.partitionBy("_piece", "_salt").orderBy("t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    met = salted.unionByName(steps, allowMissingColumns=True).withColumns({f"v{i}": F.last(f"v{i}", ignorenulls=True).over(past) for i in range(len(names))})
    met = met.where("_row = 1").join(F.broadcast(carried), "_piece")
    return met.select(*table.columns, *[F.coalesce(f"v{i}", f"b{i}").alias(f"v{i}") for i in range(len(names))]), {v: F.col(f"v{i}") for i, v in enumerate(names)}


def _bounds(times: DataFrame) -> Column:
    """Bounds of PIECES ranges of time with about as many rows of ``times`` in each, as a subquery of one row."""
    shares = F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)])
    none = F.array(*[F.lit(0).cast("long")] * (PIECES - 1))
    return times.agg(F.coalesce(F.array_sort(F.percentile_approx("t", shares, 100 * PIECES)), none).alias("b")).scalar()


def _with_piece(rows: DataFrame, bounds: Column) -> DataFrame:
    """With the range that each row's t is in, by bisection."""
    rows = rows.withColumn("_piece", F.lit(0))
    for k in range(1, PIECES.bit_length()):
        step = PIECES >> k
        rows = rows.withColumn("_piece", F.col("_piece") + F.when(F.element_at(bounds, F.col("_piece") + step) <= F.col("t"), step).otherwise(0))
    return rows


_densities: dict[tuple, float] = {}


def density(signals: DataFrame, names: list[str]) -> float:
    """Times with samples, a microsecond, in a trace on average: one pre-aggregated row, remembered for the same table."""
    key = (signals.semanticHash(), *names)
    if key not in _densities:
        rows = signals.where(F.col("signal").isin(*names)) if names else signals
        spans = rows.groupBy("trace", "signal").agg(F.count("t").alias("n"), (F.max("t") - F.min("t")).alias("span"))
        n, span = spans.groupBy("trace").agg(F.sum("n").alias("n"), F.max("span").alias("span")).agg(F.sum(F.col("n").cast("double")), F.sum(F.col("span").cast("double"))).first()
        if len(_densities) >= 256:
            _densities.clear()
        _densities[key] = (n or 0.0) / max(span or 0.0, 1.0)
    return _densities[key]


def frame_rows(signals: DataFrame, formula: Formula, names: list[str], per_second: float | None = None) -> float:
    """Rows that the frames of a formula's windows have together, on average."""
    spans = sum(micros(n.args[1]) - micros(n.args[0]) for n in formula.walk() if n.kind in ("always", "eventually"))
    if not spans:
        return 0.0
    return spans * (density(signals, names) if per_second is None else per_second / 1e6)


def verdicts(
    signals: DataFrame,
    formula: Formula,
    semantics: str = QUANTITATIVE,
    synchronization: str = "ZeroOrderHold",
    variables: dict[str, float] | None = None,
    timeline: DataFrame | None = None,
    strategy: str = "auto",
    closure: str = "any",
    horizon: int | None = None,
    bucket: float | None = None,
    grid: str = "formula",
    until_lower_bound: str = "textbook",
    arrivals: int | None = None,
    per_second: float | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Verdicts (trace, t, value | value, decided_at | lo, hi) of signals (trace, signal, t in microseconds, value[, arrival_seq]).

    strategy: "auto" ("kernel" for until, eager windows and frames of more than FRAME_ROWS rows, else "window"), "window" (built-in
    frames), "kernel" (numpy over traces, or buckets of them) or "naive" (the definition, for comparison).
    closure: "any" (some signal has reached t + depth) or "frontier" (all of the formula's have). horizon: only samples up
    to it are seen. until_lower_bound: "textbook", or "ignore" to let t' begin at t. Late samples are dropped first (with arrivals, in
    pieces of so many numbers of arrival_seq). per_second: a trace's samples in a second, for "auto"; else a scan of the table counts them once. dealt: signals are dealt by trace already, which spares the exchange (not with bucket).
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"Invalid semantics. Use one of {', '.join(SEMANTICS)}")
    if synchronization not in sync.STRATEGIES:
        raise ValueError("Invalid synchronization. Use 'ZeroOrderHold', 'Linear', or 'None'")
    formula = normalize(formula.bound(variables or {}))
    sampled, ignore = formula.bases(), until_lower_bound == "ignore"
    names = sampled + formula.derived()
    folds = any(n.kind == "until" for n in formula.walk())
    if strategy == "auto":
        closes = semantics == EAGER and formula.depth > 0  # the first time at or after a window's end would be a frame to the trace's end
        strategy = "kernel" if folds or closes or frame_rows(signals, formula, sampled, per_second) > FRAME_ROWS else "window"
    if strategy == "window" and semantics == EAGER and folds:
        strategy = "kernel"
    if bucket is not None and micros(bucket) < formula.depth:
        raise ValueError("A bucket must be as long as the formula's depth")
    if bucket is not None and (semantics == EAGER or strategy == "naive"):
        raise ValueError("Buckets are for delayed semantics and intervals")
    size = None if bucket is None else micros(bucket)
    rows = sync.drop_late(signals, arrivals) if "arrival_seq" in signals.columns else sync.present(signals)
    if horizon is not None:
        rows = rows.where(F.col("t") <= horizon)
    kernel = strategy in ("kernel", "naive")
    # What looks at no other row of its trace needn't be dealt by trace.
    alone = formula.depth == 0 and semantics in (QUANTITATIVE, QUALITATIVE) and closure == "any" and not kernel and (len(sampled) < 2 or synchronization == "None")
    if kernel and len(names) == 1 and grid == "formula" and not formula.variables():
        apart = sync.single(rows, names[0], size, dealt)
    else:
        apart = sync.wide(rows, sampled, grid, size, by_trace=not alone and not (dealt and size is None))
    table = sync.synchronize(apart, sampled, synchronization)
    made = [F.expr(expression_over(n, {b: f"s{i}" for i, b in enumerate(sampled)})) for n in names[len(sampled) :]]
    table = table.withColumns({f"s{i}": F.when(~F.isnan(c), c) for i, c in enumerate(made, len(sampled))})
    table, thresholds = _with_timeline(table, rows, formula, timeline)
    if kernel and thresholds:  # thresholds that change become signals: what a sample is above its threshold
        atoms = {f"{n.args[0]}-${n.args[1]}": n.args for n in formula.walk() if n.kind in ("gt_var", "lt_var")}
        above = {n: F.col(f"s{names.index(s)}") - thresholds[v] for n, (s, v) in atoms.items()}
        table = table.withColumns({f"s{i}": c for i, c in enumerate(above.values(), len(names))})
        formula, names = margins(formula), names + list(above)
    keys: tuple[str, ...] = ("trace",)
    if bucket is not None:
        table = _with_ends(table, table if semantics == ROSI else apart, formula, names, len(sampled), closure, semantics, thresholds)
        home = F.col(sync.PIECE)
        table = table.withColumn("_home", home).withColumn("_bucket", F.explode(F.when(F.col("t") - home * size <= formula.depth, F.array(home, home - 1)).otherwise(F.array(home))))
        keys = ("trace", "_bucket")
    if kernel:
        return _by_kernel(table, formula, names, len(sampled), semantics, strategy == "naive", ignore, closure, size)
    if bucket is None and not alone:
        over = Window.partitionBy("trace")
        end = F.max("t").over(over)
        if closure == "frontier" and len(sampled) > 1:
            end = F.least(*[F.coalesce(F.max(F.when(F.col(f"s{i}").isNotNull(), F.col("t"))).over(over), F.lit(-1)) for i in range(len(sampled))])
        table = table.withColumn("_end", end)
    compiler = Compiler(table, names, semantics, ignore, keys, thresholds)
    if bucket is not None and semantics == ROSI:
        compiler.newest = _newest(formula)
    root = compiler.compile(formula)
    found = compiler.df.where(root.member)
    if bucket is not None:
        found = found.where(F.col("_home") == F.col("_bucket"))
    if semantics in (QUANTITATIVE, QUALITATIVE):
        if not alone or bucket is not None:
            found = found.where(F.col("t") + F.lit(formula.depth) <= F.col("_end"))
        return found.select("trace", "t", root.columns[0].alias("value"))
    if semantics == ROSI:
        return found.select("trace", "t", root.columns[0].alias("lo"), root.columns[1].alias("hi"))
    return found.where(root.columns[1].isNotNull()).select("trace", "t", root.columns[0].alias("value"), root.columns[1].alias("decided_at"))


def _newest(formula: Formula) -> dict[int, str]:
    """A column for each node with a window, by its place in the formula (keys are each process's own)."""
    return {n.key: f"_m{i}" for i, n in enumerate(formula.walk()) if n.kind in ("always", "eventually", "until")}


def _members(formula: Formula, names: list[str], thresholds: dict[str, Column]) -> dict[int, Column]:
    """For each node whether a row is on its grid, which for delayed verdicts and intervals the row's own samples say."""
    found: dict[int, Column] = {}
    for node in formula.walk():
        made = F.lit(True)
        if node.kind in ("gt", "lt", "gt_var", "lt_var"):
            made = F.col(f"s{names.index(node.args[0])}").isNotNull()
            if isinstance(node.args[1], str):
                made = made & thresholds[node.args[1]].isNotNull()
        for p in node.parts:
            made = found[p.key] if made is None or len(node.parts) == 1 else made & found[p.key]
        found[node.key] = made
    return found


def _with_ends(table: DataFrame, known: DataFrame, formula: Formula, names: list[str], sampled: int, closure: str, semantics: str, thresholds: dict[str, Column]) -> DataFrame:
    """The table with its trace's _end (the time that verdicts' whole future must have reached); for intervals, with each window's newest time. ``known``: the rows that say so."""
    t, keys = F.col("t"), ("trace", sync.PIECE)
    wanted = {"_end": t}
    if closure == "frontier" and sampled > 1:
        wanted = {f"_end{i}": F.when(F.col(f"s{i}").isNotNull(), t) for i in range(sampled)}
    if semantics == ROSI:
        members, columns = _members(formula, names, thresholds), _newest(formula)
        wanted |= {columns[n.key]: F.when(members[n.key], t) for n in formula.walk() if n.key in columns}
    whole = Window.partitionBy("trace")  # over a summary row per bucket
    sums = known.groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in wanted.items()])
    ends = {n: F.max(n).over(whole) for n in wanted}
    if "_end" not in wanted:
        ends["_end"] = F.least(*[F.coalesce(ends.pop(f"_end{i}"), F.lit(-1)) for i in range(sampled)])
    return sync.with_summary(table, sums.select(*keys, *[c.alias(n) for n, c in ends.items()]), list(keys))


#: Rows that the kernel takes at a time, if they are of several traces; and the longest axis of times that they may need.
KERNEL_ROWS, AXIS = 1 << 18, 1 << 62


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows of a sorted batch at which another trace (or bucket of it) begins."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, axis: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole traces, in runs of about so many rows, with the rows at which they begin."""
    held: list[pa.RecordBatch] = []
    size, need = 0, rows
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.num_rows
            if size < need:
                continue
        if not size:
            return
        made = pa.concat_batches(held)
        starts = _starts(made, keys)
        cut = made.num_rows if batch is None else int(starts[-1])  # the last trace may go on
        held, size = [made.slice(cut)], made.num_rows - cut
        need = max(rows, 2 * size)  # a longer trace is put together a few times only
        starts = np.append(starts[starts < cut], cut)
        t = made.column("t").to_numpy()
        firsts, lasts = t[starts[:-1]].astype(np.float64), t[starts[1:] - 1].astype(np.float64)
        length = np.cumsum(lasts - firsts) if cut else np.zeros(0)
        at = 0
        while at < starts.size - 1:
            most = int(np.searchsorted(length, (length[at - 1] if at else 0.0) + axis / 2, side="right"))
            to = max(at + 1, min(most, int(np.searchsorted(starts, starts[at] + rows, side="right")) - 1))
            yield made.slice(starts[at], starts[to] - starts[at]), starts[at:to] - starts[at]
            at = to


def _on_axis(batch: pa.RecordBatch, starts: np.ndarray, names: list[str], depth: int):
    """The batch with each time once, its traces' first rows, its times on one axis, each trace's shift to it and its stretch's begin, and samples by name."""
    times = batch.column("t").to_numpy()
    first = np.zeros(times.size, dtype=bool)
    first[starts] = True
    first[1:] |= times[1:] != times[:-1]
    if not first.all():  # of equal times the least value stays
        batch, starts, times = batch.filter(pa.array(first)), np.cumsum(first)[starts] - 1, times[first]
    counts = np.diff(np.append(starts, times.size))
    first, last = times[starts], times[starts + counts - 1]
    bases = np.concatenate([[0], np.cumsum(last - first + depth + 2)[:-1]])
    shift = bases - first
    t, samples = times + np.repeat(shift, counts), {}
    for i, n in enumerate(names):
        v = batch.column(f"s{i}").to_numpy(zero_copy_only=False)
        there = ~np.isnan(v)
        samples[n] = (t[there], v[there])
    return batch, starts, t, shift, bases, samples


def summaries(signals: DataFrame, formulas: list[tuple[int, Formula]], dealt: bool = False) -> DataFrame:
    """(formula, verdicts, least, most): how many delayed quantitative verdicts each numbered formula has, and their extremes.

    All formulas are over the same one signal and without variables: its traces are dealt and sorted once, and one pass of
    the kernel evaluates all formulas, with the nodes that they share once.
    """
    plain = [(i, normalize(f)) for i, f in formulas]
    names = sorted({n for _, f in plain for n in f.bases()})
    if len(names) != 1 or any(f.bases() != names or f.derived() or f.variables() for _, f in plain):
        raise ValueError("Formulas that are evaluated together must be over the same one signal")
    depth = max(f.depth for _, f in plain)
    rows = sync.drop_late(signals) if "arrival_seq" in signals.columns else sync.present(signals)
    table = sync.single(rows, names[0], dealt=dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in _whole(batches, ["trace"], KERNEL_ROWS // 4, AXIS):
            _, _, t, _, bases, samples = _on_axis(whole, begins, names, depth)
            made, found = Evaluator(samples, QUANTITATIVE, bases=bases, grid=t), []
            end = made.last(t)
            for i, f in plain:
                got = made.rows(f)
                values = got.a[got.t + f.depth <= end[made.owner(got.t)]] + 0.0
                if values.size:
                    found.append((i, values.size, float(values.min()), float(values.max())))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["formula", "verdicts", "least", "most"])

    parts = table.select("trace", "t", "s0").sortWithinPartitions("trace", "t", "s0").mapInArrow(run, "formula int, verdicts long, least double, most double")
    sums = parts.groupBy("formula").agg(F.sum("verdicts").alias("verdicts"), F.min("least").alias("least"), F.max("most").alias("most"))
    every = signals.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i, _ in plain])).alias("formula"))
    return every.join(sums, "formula", "left").select("formula", F.coalesce("verdicts", F.lit(0).cast("long")).alias("verdicts"), "least", "most")


def _by_kernel(table: DataFrame, formula: Formula, names: list[str], sampled: int, semantics: str, naive: bool, ignore: bool, closure: str, bucket: int | None) -> DataFrame:
    """The numpy kernel over partitions sorted by trace: many traces at a time, on one axis of times."""
    kind = table.schema["trace"].dataType.simpleString()
    schema = f"trace {kind}, t long, {TYPES[semantics]}"
    keys = ["trace"] if bucket is None else ["trace", "_bucket"]

    def evaluated(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        batch, starts, t, shift, bases, samples = _on_axis(batch, starts, names, formula.depth)

        def of_trace(column: str) -> np.ndarray:
            return batch.column(column).take(pa.array(starts)).fill_null(-1).to_numpy() + shift

        newest = {key: of_trace(c) for key, c in _newest(formula).items() if c in batch.schema.names}
        made = Evaluator(samples, semantics, naive, ignore, bases=bases, newest=newest, grid=t)
        found = made.rows(formula)
        owner = made.owner(found.t)
        own = found.t - shift[owner]
        keep = np.ones(own.size, dtype=bool)
        if bucket is not None:
            keep &= own // bucket == batch.column("_bucket").take(pa.array(starts)).to_numpy()[owner]
        if semantics in (QUANTITATIVE, QUALITATIVE):
            if bucket is not None:
                end = of_trace("_end")
            else:
                end = made.last(t) if closure == "any" or not names else np.minimum.reduce([made.last(samples[n][0]) for n in names[:sampled]])
            keep &= found.t + formula.depth <= end[owner]
        elif semantics == EAGER:
            keep &= found.b != NEVER
        owner, own = owner[keep], own[keep]
        match semantics:
            case "DelayedQuantitative":
                values = [found.a[keep] + 0.0]
            case "DelayedQualitative":
                values = [found.a[keep]]
            case "EagerQualitative":
                values = [found.a[keep], found.b[keep] - shift[owner]]
            case _:
                values = [found.a[keep] + 0.0, found.b[keep] + 0.0]
        trace = batch.column("trace").take(pa.array(starts[owner]))
        return pa.RecordBatch.from_arrays([trace, pa.array(own), *map(pa.array, values)], [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole(batches, keys, 1 if naive else KERNEL_ROWS, AXIS):
            yield evaluated(batch, starts)

    rows = table if bucket is None else table.repartition(*keys)
    wanted = [*keys, "t", *[f"s{i}" for i in range(len(names))], *[c for c in rows.columns if c == "_end" or c.startswith("_m")]]
    values = [f"s{i}" for i in range(len(names))] if len(names) == 1 else []
    return rows.select(*wanted).sortWithinPartitions(*keys, "t", *values).mapInArrow(run, schema)
