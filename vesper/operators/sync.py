"""Signals of a trace on common times: late samples dropped, then a wide row per time with one column per signal.

What a row takes from others of its trace (the sample before it, the one after it, how far its signal has come) is a scan in order. A trace may
be scanned in pieces: pieces are ranges of time (or of arrival) with a column of their own, each has a summary row, a
window over a trace's few summary rows carries values from piece to piece, and each piece is scanned by itself from what it is
handed. So a trace with a third of all rows is spread over as many tasks as it has pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

STRATEGIES = ("ZeroOrderHold", "Linear", "None")
#: The column that says in which piece of its trace a row is.
PIECE = "_at"


def present(signals: DataFrame) -> DataFrame:
    """Rows that are samples: with trace, signal, t and a value that isn't NaN."""
    return signals.where("trace is not null and signal is not null and t is not null and value is not null and not isnan(value)")


def piece(column: str, width: int) -> Column:
    """Ranges of ``width``; rows without a number are before all."""
    return F.coalesce(F.floor(F.col(column) / F.lit(width)).cast("long"), F.lit(-(1 << 62)))


def _before(*keys: str, order: Column | str, others: tuple = ()) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order, *others).rowsBetween(Window.unboundedPreceding, -1)


def with_summary(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the summary of their piece. Rows stay dealt by piece: a broadcast of either side would leave them where the other is, by trace."""
    return rows.join(summary.hint("shuffle_hash"), keys)


def drop_late(signals: DataFrame, run: int | None = None) -> DataFrame:
    """Without the samples that come at or before a time that their own signal has already reached.

    By arrival_seq if there is one (with ``run``, a signal's arrivals are scanned in pieces of so many numbers); else of
    equal (trace, signal, t) the least value stays. Rows without trace, signal, t or value, or with a NaN value, are no samples.
    """
    there = present(signals)
    if "arrival_seq" not in signals.columns:
        return there.groupBy("trace", "signal", "t").agg(F.min("value").alias("value"))
    keys, earlier = ("trace", "signal"), F.lit(None).cast("long")
    if run is not None:
        there = there.withColumn(PIECE, piece("arrival_seq", run))
        sums = there.groupBy(*keys, PIECE).agg(F.max("t").alias("_most"))
        there = with_summary(there, sums.select(*keys, PIECE, F.max("_most").over(_before(*keys, order=PIECE)).alias("_earlier")), [*keys, PIECE])
        keys, earlier = (*keys, PIECE), F.col("_earlier")
    reached = F.greatest(earlier, F.max("t").over(_before(*keys, order="arrival_seq", others=("t", "value"))))
    found = there.withColumn("_reached", reached)
    return found.where(F.col("_reached").isNull() | (F.col("t") > F.col("_reached"))).select(*signals.columns)


def single(signals: DataFrame, name: str, size: int | None = None, dealt: bool = False) -> DataFrame:
    """What ``wide`` gives for one signal, but with equal times as they are, for what sorts them anyway. ``dealt``: the signals are dealt by trace already."""
    keys = ("trace",) if size is None else ("trace", PIECE)
    rows = signals.where(F.col("signal") == name)
    rows = rows.select("trace", "t", F.col("value").alias("s0"), *([] if size is None else [piece("t", size).alias(PIECE)]))
    return rows if dealt and size is None else rows.repartition(*keys)


def wide(signals: DataFrame, names: list[str], grid: str = "formula", size: int | None = None, by_trace: bool = True) -> DataFrame:
    """(trace, t, s0, s1, ...): one exchange on trace, which later windows use again; with ``size``, one on trace and pieces of so many microseconds.

    Without ``by_trace`` on trace and time, for what looks at no other row.

    Of equal (trace, signal, t) the least value stays.
    """
    rows = signals if grid == "all" or not names else signals.where(F.col("signal").isin(*names))
    keys = ("trace",) if size is None else ("trace", PIECE)
    rows = rows.select("trace", "t", "signal", "value", *([] if size is None else [piece("t", size).alias(PIECE)]))
    rows = rows.repartition(*keys) if by_trace else rows
    return rows.groupBy(*keys, "t").agg(*[F.min(F.when(F.col("signal") == n, F.col("value"))).alias(f"s{i}") for i, n in enumerate(names)], F.count("*").alias("_n")).drop("_n")


def synchronize(table: DataFrame, names: list[str], strategy: str) -> DataFrame:
    """Fills each signal between its first and last sample, by its last value or linearly in seconds; piece by piece if the table has pieces."""
    if strategy == "None" or len(names) < 2:
        return table
    pairs = [F.when(F.col(f"s{i}").isNotNull(), F.struct(F.col("t").alias("t"), F.col(f"s{i}").alias("v"))) for i in range(len(names))]
    keys = [k for k in ("trace", PIECE) if k in table.columns]
    if PIECE in keys:
        ends = [c for i, p in enumerate(pairs) for c in (F.max_by(p, F.when(p.isNotNull(), F.col("t"))).alias(f"_z{i}"), F.min_by(p, F.when(p.isNotNull(), F.col("t"))).alias(f"_a{i}"))]
        sums, ahead = table.groupBy(*keys).agg(*ends), _before("trace", order=F.desc(PIECE))
        carried = [c for i in range(len(names)) for c in (F.last(f"_z{i}", ignorenulls=True).over(_before("trace", order=PIECE)).alias(f"_was{i}"), F.last(f"_a{i}", ignorenulls=True).over(ahead).alias(f"_will{i}"))]
        table = with_summary(table, sums.select(*keys, *carried), keys)
    # Frames only grow: the samples after a row, if their values are asked for, are scanned from the latest back.
    past, whole = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    back, found = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0), {}
    for i, pair in enumerate(pairs):
        was, will = F.last(pair, ignorenulls=True).over(past), F.last(pair, ignorenulls=True).over(back)
        if strategy == "ZeroOrderHold":
            will = F.when(F.col("t") <= F.max(pair["t"]).over(whole), F.struct(F.col("t").alias("t"), F.lit(0.0).alias("v")))  # there is one
        found |= {f"_p{i}": F.coalesce(was, F.col(f"_was{i}")) if PIECE in keys else was, f"_n{i}": F.coalesce(will, F.col(f"_will{i}")) if PIECE in keys else will}
    filled = []
    for i in range(len(names)):
        s, was, will = F.col(f"s{i}"), F.col(f"_p{i}"), F.col(f"_n{i}")
        share = ((F.col("t") - was["t"]) / F.lit(1e6)) / ((will["t"] - was["t"]) / F.lit(1e6))
        between = F.when(will.isNotNull(), was["v"]) if strategy == "ZeroOrderHold" else was["v"] + (will["v"] - was["v"]) * share
        filled.append(F.coalesce(s, between).alias(f"s{i}"))
    return table.withColumns(found).select(*keys, "t", *filled)
