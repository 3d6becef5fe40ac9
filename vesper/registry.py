"""Every query over the monitoring engine, by name, with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import intervals
from .monitor import Monitor
from .operators.trace import EAGER, QUALITATIVE, QUANTITATIVE, ROSI
from .plans import catalog, planner
from .plans.formula import Formula
from .plans.parser import parse_stl
from .plans.sqltext import INF, signals_base, verdict_sql
from .sources import signals

FLAGSHIP = "globally_quant"
DAY = 86_400
EVENTS = "select user_id as trace, 'value' as signal, epoch_us(ts) as t, value, event_id as arrival_seq from events"
TYPED = "select user_id as trace, event_type as signal, epoch_us(ts) as t, value, event_id as arrival_seq from events"

# Name: (formula, semantics). Signal value of events, a trace per user.
SINGLE: dict[str, tuple[str, str]] = {
    "atom_gt": ("value > 50", QUANTITATIVE), "atom_lt": ("value < 50", QUANTITATIVE), "atom_ge": ("value >= 50", QUANTITATIVE),
    "atom_le": ("value <= 50", QUANTITATIVE), "atom_eq": ("value == 50", QUANTITATIVE), "atom_gt_bool": ("value > 50", QUALITATIVE), "atom_lt_bool": ("value < 50", QUALITATIVE),
    "atom_ge_bool": ("value >= 50", QUALITATIVE), "atom_le_bool": ("value <= 50", QUALITATIVE), "atom_eq_bool": ("value == 50", QUALITATIVE),
    "const_true": ("value > 0 or true", QUANTITATIVE), "const_false_bool": ("value > 0 and false", QUALITATIVE),
    "not_quant": ("!(value > 50)", QUANTITATIVE), "not_bool": ("!(value > 50)", QUALITATIVE),
    "and_quant": ("value > 20 and value < 100", QUANTITATIVE), "and_bool": ("value > 20 and value < 100", QUALITATIVE),
    "or_quant": ("value < 20 or value > 100", QUANTITATIVE), "or_bool": ("value < 20 or value > 100", QUALITATIVE),
    "implies_quant": ("value > 20 -> value > 100", QUANTITATIVE), "implies_bool": ("value > 20 -> value > 100", QUALITATIVE),
    "globally_quant": (f"G[0,{DAY}](value < 200)", QUANTITATIVE), "globally_bool": (f"G[0,{DAY}](value < 200)", QUALITATIVE), "globally_offset": (f"G[21600,{DAY}](value < 200)", QUANTITATIVE),
    "eventually_quant": (f"F[0,{DAY}](value > 100)", QUANTITATIVE), "eventually_bool": (f"F[0,{DAY}](value > 100)", QUALITATIVE), "eventually_offset": (f"F[21600,{DAY}](value > 100)", QUANTITATIVE),
    "nested_fg": (f"F[0,{2 * DAY}](G[0,{DAY}](value < 150))", QUANTITATIVE), "nested_gf": (f"G[0,{2 * DAY}](F[0,{DAY}](value > 60))", QUANTITATIVE), "nested_gf_bool": (f"G[0,{2 * DAY}](F[0,{DAY}](value > 60))", QUALITATIVE),
    "response": (f"G[0,{2 * DAY}](value > 200 -> F[0,{DAY}](value < 20))", QUANTITATIVE),
    "until_quant": (f"(value < 150) U[0,{2 * DAY}] (value > 60)", QUANTITATIVE), "until_bool": (f"(value < 150) U[0,{2 * DAY}] (value > 60)", QUALITATIVE),
    "until_offset": (f"(value < 150) U[{DAY},{3 * DAY}] (value > 60)", QUANTITATIVE), "until_nested": (f"(G[0,{DAY}](value < 250)) U[0,{2 * DAY}] (F[0,{DAY}](value > 100))", QUANTITATIVE),
    "rosi_globally": (f"G[0,{DAY}](value < 200)", ROSI), "rosi_response": (f"G[0,{2 * DAY}](value > 200 -> F[0,{DAY}](value < 20))", ROSI), "rosi_until": (f"(value < 150) U[0,{2 * DAY}] (value > 60)", ROSI),
}
# Signals click and view of events on common times.
PAIRED = {"sync_zoh_and": "ZeroOrderHold", "sync_linear_and": "Linear"}
PAIR = "click > 20 and view < 150"
WINDOWED_PAIR = f"G[0,{DAY}](click > 5 -> F[0,{DAY}](view > 5))"
KERNEL = f"G[0,{3 * DAY}](value > 200 -> F[0,{2 * DAY}](value < 20))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.from_events(_events(spark, sf_dir)).drop("arrival_seq")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.from_events(_events(spark, sf_dir), None).drop("arrival_seq")


def _plain(text: str, semantics: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: planner.verdicts(_single(spark, sf_dir), parse_stl(text), semantics, **options)


def _pair(text: str, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: planner.verdicts(_typed(spark, sf_dir), parse_stl(text), QUANTITATIVE, strategy)


def eager(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return _plain(text, EAGER)


EAGER_G = "value < 200"


def eager_sql(cut: str, empty: str, span: int) -> str:
    """G or F over value < 200: the truth and the first time at which it is decided, released in order."""
    return f"""
with base as (select user_id as trace, epoch_us(ts) as t, min(value) as v from events group by all),
swept as (
  select *, v < 200 as a, min(case when (v < 200) = {cut} then t end) over (partition by trace order by t range between 0 following and {span} following) as soonest,
    min(t) over (partition by trace order by t range between {span} following and unbounded following) as closed from base
), decided as (
  select trace, t, case when soonest is not null then {cut} else {empty} end as value,
    case when soonest is not null then least(coalesce(closed, 9223372036854775807), greatest(t, soonest)) else coalesce(closed, 9223372036854775807) end as d from swept
)
select trace, t, value, decided_at from (select trace, t, value, max(d) over (partition by trace order by t) as decided_at from decided) where decided_at < 9223372036854775807
"""


EAGER_UNTIL_SQL = f"""
with base as (select user_id as trace, epoch_us(ts) as t, min(value) as v from events group by all),
swept as (
  select *, min(case when not v < 150 then t end) over w as fails, min(case when v > 60 then t end) over w as hit,
    min(t) over (partition by trace order by t range between {2 * DAY * 1_000_000} following and unbounded following) as closed
  from base window w as (partition by trace order by t range between 0 following and {2 * DAY * 1_000_000} following)
), decided as (
  select trace, t, hit is not null and (fails is null or hit < fails) as value,
    least(coalesce(closed, 9223372036854775807), case when hit is not null and (fails is null or hit < fails) then hit else coalesce(fails, 9223372036854775807) end) as d from swept
)
select trace, t, value, decided_at from (select trace, t, value, max(d) over (partition by trace order by t) as decided_at from decided) where decided_at < 9223372036854775807
"""


def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event comes after all others, so most of these are late."""
    rows = signals.from_events(_events(spark, sf_dir))
    delay = F.when(F.col("arrival_seq") % 5 == 0, F.lit(LATE)).otherwise(F.lit(0))
    return planner.verdicts(rows.withColumn("arrival_seq", F.col("arrival_seq") + delay), parse_stl("value > 50"))


LATE = 1_000_000_000_000
OTHERS = ["error", "purchase", "signup"]
LATE_EVENTS = f"select user_id as trace, 'value' as signal, epoch_us(ts) as t, value, event_id + case when event_id % 5 = 0 then {LATE} else 0 end as arrival_seq from events"


def sync_none_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views on the three days that they are in, so that both signals have many times in common."""
    return planner.verdicts(_days(spark, sf_dir), parse_stl(PAIR), QUANTITATIVE, "None")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).withColumn("t", F.col("t") - F.col("t") % (3 * DAY * 1_000_000))


DAYS = f"select user_id as trace, event_type as signal, epoch_us(ts) - epoch_us(ts) % {3 * DAY * 1_000_000} as t, value, event_id as arrival_seq from events"


def closure_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts only where both signals have reached the end of the windows."""
    return planner.verdicts(_typed(spark, sf_dir), parse_stl(WINDOWED_PAIR), closure="frontier")


def grid_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks held on the times of all signals, not only of the formula's two."""
    return planner.verdicts(_typed(spark, sf_dir), parse_stl(PAIR), grid="all")


def eager_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.verdicts(_typed(spark, sf_dir), parse_stl("click > 20 and view < 150"), EAGER)


def eager_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.verdicts(_typed(spark, sf_dir), parse_stl("click > 20 or view < 150"), EAGER)


WEIGHED = Formula.always(0, DAY, Formula.pred("click * 0.5 + view", ">", 40.0))


def predicate_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate over an expression of two signals, held on common times."""
    return planner.verdicts(_typed(spark, sf_dir), WEIGHED)


def emission_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each verdict came, in the order it came."""
    rows = _events(spark, sf_dir).groupBy("user_id", "ts").agg(F.min("value").alias("value"), F.min("event_id").alias("event_id"))
    return Monitor(SINGLE["globally_quant"][0]).emissions(signals.from_events(rows).drop("arrival_seq"))


def latest_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the refinements that a log of intervals has for each time."""
    rows = _events(spark, sf_dir).where(f"unix_micros(cast(ts as timestamp)) <= {WEEK}").groupBy("user_id", "ts").agg(F.min("value").alias("value"), F.min("event_id").alias("event_id"))
    log = Monitor(SINGLE["rosi_globally"][0], ROSI).emissions(signals.from_events(rows).drop("arrival_seq"))
    last = log.groupBy("trace", "t").agg(F.max_by(F.struct("lo", "hi"), "seq").alias("v"))
    return last.select("trace", "t", "v.lo", "v.hi")


WEEK = 1_704_672_000_000_000


def eager_pair_sql(cut: str) -> str:
    """And (cut false) or Or (cut true) of two atoms, each decided at its own time: a side that is ``cut`` decides alone."""
    return f"""
with {signals_base(["click", "view"], TYPED, "ZeroOrderHold")},
sides as (select trace, t, s0 > 20 as x, s1 < 150 as y from base)
select trace, t, case when x = {cut} or y = {cut} then {cut} else not {cut} end as value, t as decided_at from sides
where x = {cut} or y = {cut} or (x is not null and y is not null)
"""


def variables_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.verdicts(_single(spark, sf_dir), parse_stl(f"G[0,{DAY}](value < $limit)"), variables={"limit": 180.0})


def variables_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold is each user's purchase value that was seen last."""
    rows = _events(spark, sf_dir)
    timeline = signals.from_events(rows.where("event_type = 'purchase'")).select("trace", "t", F.lit("limit").alias("name"), "value")
    return planner.verdicts(signals.from_events(rows.where("event_type <> 'purchase'")).drop("arrival_seq"), parse_stl("value > $limit"), timeline=timeline)


ASOF_SQL = """
with base as (select user_id as trace, epoch_us(ts) as t, min(value) as s0 from events where event_type <> 'purchase' group by all),
steps as (select user_id as trace, epoch_us(ts) as t, max(value) as v0 from events where event_type = 'purchase' group by all)
select b.trace, b.t, b.s0 - s.v0 + 0.0 as value from base b asof join steps s on b.trace = s.trace and b.t >= s.t
"""


def rosi_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals as they stand in the middle of January."""
    return planner.verdicts(_single(spark, sf_dir), parse_stl(SINGLE["rosi_response"][0]), ROSI, horizon=HORIZON)


HORIZON = 1_705_276_800_000_000


def violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.report(planner.verdicts(_single(spark, sf_dir), parse_stl(SINGLE["globally_quant"][0])))


def dataset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _single(spark, sf_dir)
    return signals.dataset(rows.select("trace", "t", "value"), planner.verdicts(rows, parse_stl(SINGLE["response"][0])))


def interval_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planner.verdicts(_single(spark, sf_dir), parse_stl(SINGLE["rosi_globally"][0]), ROSI).where("lo > double('-Infinity')")
    x, y = (F.col("lo"), F.col("hi")), (F.lit(0.5), F.lit(1.5))
    columns = [("sum", intervals.add(x, y)), ("difference", intervals.subtract(x, y)), ("negated", intervals.negate(x))]
    return rows.select("trace", "t", *[(c + F.lit(0.0)).alias(f"{name}_{end}") for name, pair in columns for end, c in zip(("lo", "hi"), pair, strict=True)], intervals.decided(x).alias("decided"))


def signal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's grid of times with both signals held, as the planner aligns them."""
    from .operators import sync

    names = ["click", "view"]
    return sync.synchronize(sync.wide(sync.drop_late(_typed(spark, sf_dir)), names), names, "ZeroOrderHold")


def orders_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.daily(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderdate", "o_totalprice", "price")
    return planner.verdicts(rows, parse_stl(f"F[0,{90 * DAY}](price > 200000)"), dealt=True)


def lineitem_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.daily(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_shipdate", "l_quantity", "qty")
    return planner.verdicts(rows, parse_stl(LINEITEM), dealt=True)


LINEITEM = f"G[0,{30 * DAY}](qty > 90 -> F[0,{20 * DAY}](qty < 10))"


def _daily(table: str, trace: str, day: str, value: str) -> str:
    return f"base as (select {trace} as trace, epoch_us({day}::date::timestamp) as t, round(sum({value}), 2) as s0 from {table} group by all)"


def formula_catalog(spark: SparkSession, sf_dir: str, strategy: str = "auto") -> DataFrame:
    """All benchmark formulas over each supplier's daily quantities, about 1 at most, a day as a second: counts of verdicts and extremes. "auto" evaluates all in one pass."""
    days = signals.daily(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_shipdate", "l_quantity", "x")
    rows = days.select("trace", "signal", (F.col("t") / F.lit(DAY)).cast("long").alias("t"), (F.col("value") / F.lit(64.0) - F.lit(0.5)).alias("value"))
    if strategy == "auto":
        return planner.summaries(rows, catalog.get_formulas(), dealt=True).withColumns({c: F.round(c, 6) for c in ("least", "most")})
    made = None
    for i, f in catalog.get_formulas():
        one = planner.verdicts(rows, f, strategy=strategy, dealt=True).agg(F.lit(i).alias("formula"), F.count("*").alias("verdicts"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
        made = one if made is None else made.union(one)
    return made


def formula_catalog_sql() -> str:
    base = "base as (select l_suppkey as trace, epoch_us(l_shipdate::date::timestamp) // 86400 as t, round(sum(l_quantity), 2) / 64.0 - 0.5 as s0 from lineitem group by all)"
    parts = [f"select {i} as formula, count(*) as verdicts, round(min(value), 6) as least, round(max(value), 6) as most from ({verdict_sql(f, base, names=['x'])})" for i, f in catalog.get_formulas()]
    return " union all ".join(parts)


def _base(**options) -> str:
    return signals_base(["value"], EVENTS, **options)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _plain(text, semantics) for name, (text, semantics) in SINGLE.items()}
    found |= {name: _pair(PAIR, strategy) for name, strategy in PAIRED.items()}
    found |= {"sync_zoh_windows": _pair(WINDOWED_PAIR, "ZeroOrderHold"), "sync_linear_windows": _pair(WINDOWED_PAIR, "Linear")}
    found |= {"eager_globally": eager(f"G[0,{DAY}]({EAGER_G})"), "eager_eventually": eager(f"F[0,{DAY}]({EAGER_G})"), "eager_until": eager(SINGLE["until_bool"][0])}
    found |= {"until_ignore_start": _plain(SINGLE["until_offset"][0], QUANTITATIVE, until_lower_bound="ignore"), "bucketed": _plain(SINGLE["response"][0], QUANTITATIVE, bucket=4 * DAY)}
    found |= {"kernel_response": _plain(KERNEL, QUANTITATIVE, strategy="kernel"), "kernel_until": _plain(SINGLE["until_quant"][0], QUANTITATIVE, strategy="kernel"), "naive_response": _plain(SINGLE["response"][0], QUANTITATIVE, strategy="naive")}
    own = (late_drop, sync_none_and, closure_frontier, grid_all, eager_and, eager_or, emission_log, latest_intervals, variables_static, variables_asof, rosi_horizon, violation_report, dataset_join, interval_arithmetic, signal_union, orders_price, lineitem_quantity, formula_catalog, predicate_expression)
    return found | {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    parsed = {name: (parse_stl(text), semantics) for name, (text, semantics) in SINGLE.items()}
    found = {name: verdict_sql(f, _base(), semantics, ["value"]) for name, (f, semantics) in parsed.items()}
    pair = ["click", "view"]
    found |= {name: verdict_sql(parse_stl(PAIR), signals_base(pair, TYPED, strategy), names=pair) for name, strategy in PAIRED.items()}
    for kind, strategy in (("zoh", "ZeroOrderHold"), ("linear", "Linear")):
        found[f"sync_{kind}_windows"] = verdict_sql(parse_stl(WINDOWED_PAIR), signals_base(pair, TYPED, strategy), names=pair)
    found["eager_globally"] = eager_sql("false", "true", DAY * 1_000_000)
    found["eager_eventually"] = eager_sql("true", "false", DAY * 1_000_000)
    found["eager_until"] = EAGER_UNTIL_SQL
    found["until_ignore_start"] = verdict_sql(parsed["until_offset"][0], _base(), names=["value"], ignore_start=True)
    found["bucketed"] = found["naive_response"] = found["response"]
    found["kernel_response"] = verdict_sql(parse_stl(KERNEL), _base(), names=["value"])
    found["kernel_until"] = found["until_quant"]
    found["late_drop"] = verdict_sql(parse_stl("value > 50"), signals_base(["value"], LATE_EVENTS, late=True), names=["value"])
    found["sync_none_and"] = verdict_sql(parse_stl(PAIR), signals_base(pair, DAYS), names=pair)
    windowed = parse_stl(WINDOWED_PAIR)
    reached = f"select user_id as trace, least(max(epoch_us(ts)) filter (event_type = 'click'), max(epoch_us(ts)) filter (event_type = 'view')) as reached from events group by user_id having count(distinct event_type) filter (event_type in ('click', 'view')) = 2"
    found["closure_frontier"] = f"select v.* from ({found['sync_zoh_windows']}) v join ({reached}) using (trace) where t + {windowed.depth} <= reached"
    found["closure_frontier"] = found["closure_frontier"].replace("select v.* from", "select v.trace, v.t, v.value from")
    every = ["click", "view", *OTHERS]
    found["grid_all"] = verdict_sql(parse_stl(PAIR), signals_base(every, TYPED, "ZeroOrderHold"), names=every)
    depth = parsed["globally_quant"][0].depth
    found["emission_log"] = f"""
with verdicts as ({found["globally_quant"]}), seen as (select distinct user_id as trace, epoch_us(ts) as u from events)
select trace, emitted_at, row_number() over (partition by trace order by t) as seq, t, value
from (select v.trace, min(s.u) as emitted_at, v.t, v.value from verdicts v join seen s on v.trace = s.trace and s.u >= v.t + {depth} group by v.trace, v.t, v.value)
"""
    found["latest_intervals"] = verdict_sql(parsed["rosi_globally"][0], _base(until=f"and t <= {WEEK}"), ROSI, ["value"])
    found["eager_and"], found["eager_or"] = eager_pair_sql("false"), eager_pair_sql("true")
    found["variables_static"] = verdict_sql(parse_stl(f"G[0,{DAY}](value < 180)"), _base(), names=["value"])
    found["variables_asof"] = ASOF_SQL
    found["rosi_horizon"] = verdict_sql(parsed["rosi_response"][0], _base(until=f"and t <= {HORIZON}"), ROSI, ["value"])
    found["violation_report"] = f"select trace, count(*) as verdicts, count(*) filter (value < 0) as violations, min(value) as worst, min(t) filter (value < 0) as first_violation from ({found['globally_quant']}) group by trace"
    found["dataset_join"] = f"select e.user_id as trace, epoch_us(e.ts) as t, e.value, v.value as verdict from events e left join ({found['response']}) v on e.user_id = v.trace and epoch_us(e.ts) = v.t"
    found["interval_arithmetic"] = f"select trace, t, lo + 0.5 as sum_lo, hi + 1.5 as sum_hi, lo - 1.5 as difference_lo, hi - 0.5 as difference_hi, -hi + 0.0 as negated_lo, -lo + 0.0 as negated_hi, lo = hi as decided from ({found['rosi_globally']}) where lo > -{INF}"
    found["signal_union"] = f"with {signals_base(pair, TYPED, 'ZeroOrderHold')} select * from base"
    found["predicate_expression"] = verdict_sql(WEIGHED, signals_base(pair, TYPED, "ZeroOrderHold"), names=pair)
    found["formula_catalog"] = formula_catalog_sql()
    found["orders_price"] = verdict_sql(parse_stl(f"F[0,{90 * DAY}](price > 200000)"), _daily("orders", "o_custkey", "o_orderdate", "o_totalprice"), names=["price"])
    found["lineitem_quantity"] = verdict_sql(parse_stl(LINEITEM), _daily("lineitem", "l_suppkey", "l_shipdate", "l_quantity"), names=["qty"])
    return found


__all__ = ["FLAGSHIP", "Formula", "oracle_sql", "queries"]
