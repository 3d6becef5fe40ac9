"""The window planner against the definition and the kernel, on random formulas and irregular traces; and streaming against batch."""

import random

import pytest
from pyspark.sql import functions as F

from vesper import Formula, Monitor, StlParseError, parse_stl
from vesper.operators import sync
from vesper.plans import planner
from vesper.plans.formula import normalize
from vesper.sources import signals

SCHEMA = "trace string, signal string, t long, value double"


def formula(rnd, depth, names="x"):
    if depth == 0:
        return rnd.choice([Formula.gt, Formula.lt])(rnd.choice(names), rnd.choice([-1, 0, 1]))
    a = rnd.choice([0, 0, 1, 2])
    span = (a, a + rnd.choice([0, 1, 3]))
    part = lambda: formula(rnd, depth - 1, names)
    match rnd.randrange(7):
        case 0:
            return Formula.not_(part())
        case 1:
            return Formula.and_(part(), part())
        case 2:
            return Formula.implies(part(), part())
        case 3:
            return Formula.or_(part(), part())
        case 4:
            return Formula.until(*span, part(), part())
        case 5:
            return Formula.always(*span, part())
    return Formula.eventually(*span, part())


def samples(spark, rnd, names="x", traces=4, n=40):
    rows = []
    for k in range(traces):
        for s in names:
            t = 0
            for _ in range(n):
                t += rnd.choice([1, 1, 1, 2, 5]) * 500_000
                rows.append((f"tr{k}", s, t, float(rnd.randint(-3, 3))))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("semantics", ["DelayedQuantitative", "DelayedQualitative", "Rosi", "EagerQualitative"])
def test_window_plan_is_the_kernel_and_the_definition(spark, semantics):
    rnd = random.Random(semantics)
    for names in ("x", "xy"):
        data = samples(spark, rnd, names).cache()
        for _ in range(4):
            f = formula(rnd, 2, names)
            got = rows(planner.verdicts(data, f, semantics, strategy="window"))
            assert got == rows(planner.verdicts(data, f, semantics, strategy="kernel")), str(f)
            if semantics.startswith("Delayed"):
                assert got == rows(planner.verdicts(data, f, semantics, strategy="naive")), str(f)
                if f.depth:
                    for strategy in ("window", "kernel"):
                        assert got == rows(planner.verdicts(data, f, semantics, bucket=f.depth / 1e6 + 3, strategy=strategy)), str(f)


def test_laws(spark):
    rnd = random.Random(8)
    data = samples(spark, rnd).cache()
    for a, b in (("G[0,3](x > 0)", "!(F[0,3](!(x > 0)))"), ("F[0,3](x > 0)", "true U[0,3] x > 0"), ("!(x > 0 and x < 2)", "!(x > 0) or !(x < 2)")):
        assert rows(planner.verdicts(data, parse_stl(a))) == rows(planner.verdicts(data, parse_stl(b)))


def test_eager_agrees_with_delayed_and_is_no_later(spark):
    rnd = random.Random(9)
    data = samples(spark, rnd).cache()
    for text in ("G[0,3](x > -2)", "F[0,2](x > 1)", "x > -1 U[0,3] x > 1"):
        f = parse_stl(text)
        eager = {(r.trace, r.t): r for r in planner.verdicts(data, f, "EagerQualitative").collect()}
        for r in planner.verdicts(data, f, "DelayedQualitative").collect():
            assert eager[(r.trace, r.t)].value == r.value


def test_one_exchange_on_trace(spark):
    data = samples(spark, random.Random(1))
    df = planner.verdicts(data.groupBy("trace", "signal", "t").agg(F.min("value").alias("value")), parse_stl("G[0,2](x > 0 -> F[0,1](x < 0))"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(trace#") - plan.count("signal#", 0) <= 2 and "Python" not in plan


def test_late_and_missing_samples(spark):
    data = spark.createDataFrame([("a", "x", 5, 1.0, 1), ("a", "x", 4, 2.0, 2), ("a", "x", 5, 3.0, 3), ("a", "x", 6, 4.0, 4), ("a", "x", 7, float("nan"), 5), (None, "x", 1, 1.0, 6), ("a", None, 1, 1.0, 7), ("a", "x", None, 1.0, 8)], SCHEMA + ", arrival_seq long")
    assert rows(sync.drop_late(data).select("t", "value")) == [(5, 1.0), (6, 4.0)]
    assert rows(planner.verdicts(data.where("false"), parse_stl("G[0,1](x>0)"))) == []
    with pytest.raises(ValueError, match="not found"):
        planner.verdicts(data, parse_stl("x > $limit"))


def test_frontier_closure_waits_for_all_signals(spark):
    data = spark.createDataFrame([("a", "x", t * 1_000_000, 1.0) for t in range(6)] + [("a", "y", t * 1_000_000, 1.0) for t in range(3)], SCHEMA)
    f = parse_stl("G[0,1](x > 0) and G[0,1](y > 0)")
    assert [t for t, *_ in rows(planner.verdicts(data, f))] == [0, 1_000_000, 2_000_000]
    assert [t for t, *_ in rows(planner.verdicts(data, f, closure="frontier"))] == [0, 1_000_000]


def test_a_hot_trace_is_spread_over_tasks(spark):
    data = spark.range(9000).selectExpr("if(id < 3000, 'hot', concat('t', id % 100)) as trace", "'x' as signal", "id * 1000000 as t", "cast(id % 7 as double) as value")
    for text in ("G[0,10](x > 0)", "x > 0 U[0,10] x > 5"):
        df = planner.verdicts(data, parse_stl(text), bucket=100.0)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would go to one task
        try:
            tasks = df.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("trace") == "hot").alias("n")).where("n > 0").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(tasks) > 3 and max(r.n for r in tasks) < 1500 and rows(df) == rows(planner.verdicts(data, parse_stl(text)))


def test_long_timeline_without_traces(spark):
    rnd = random.Random(3)
    data = samples(spark, rnd)
    steps = [(rnd.randrange(-5, 60) * 700_000, rnd.choice(["limit", "floor"]), float(rnd.randint(-2, 2))) for _ in range(400)]
    timeline = spark.createDataFrame(steps, "t long, name string, value double")
    by_trace = timeline.crossJoin(data.select("trace").distinct())
    f = parse_stl("F[0,2](x > $limit and x < $floor)")
    assert rows(planner.verdicts(data, f, timeline=timeline)) == rows(planner.verdicts(data, f, timeline=by_trace)) != []


def test_global_timeline_of_a_variable(spark):
    data = spark.createDataFrame([("a", "x", t, 5.0) for t in range(5)], SCHEMA)
    steps = spark.createDataFrame([(1, "limit", 2.0), (3, "limit", 4.0)], "t long, name string, value double")
    assert rows(planner.verdicts(data, parse_stl("x > limit"), timeline=steps)) == [(1, "a", 3.0), (2, "a", 3.0), (3, "a", 1.0), (4, "a", 1.0)]


def test_stream_is_batch(spark, tmp_path):
    rnd = random.Random(12)
    data = [(f"tr{k}", "x", t * 1_000_000, float(rnd.randint(-3, 3))) for k in range(3) for t in range(30)]
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([r for r in data if i * 10_000_000 <= r[2] < (i + 1) * 10_000_000], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    for text, semantics in (("G[0,3](x > -2)", "DelayedQuantitative"), ("F[0,2](x > 1)", "EagerQualitative")):
        monitor = Monitor(text, semantics)
        stream = monitor.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        query = stream.writeStream.format("memory").queryName("out_" + semantics).option("checkpointLocation", str(tmp_path / semantics)).trigger(availableNow=True).start()
        query.awaitTermination()
        got = sorted(tuple(r) for r in spark.table("out_" + semantics).collect())
        want = sorted(tuple(r) for r in monitor.evaluate(spark.createDataFrame(data, SCHEMA)).select("trace", "t", "value").collect())
        assert got == want and got


def test_stream_of_two_signals_with_late_rows_is_its_emission_log(spark, tmp_path):
    rnd = random.Random(13)
    data = [(f"tr{k}", s, t * 1_000_000, float(rnd.randint(-3, 3))) for t in range(24) for k in range(2) for s in "xy"]
    data = [(*r, i if i % 9 else i + 30) for i, r in enumerate(data)]  # some come late
    data.sort(key=lambda r: r[4])
    schema, source = SCHEMA + ", arrival_seq long", str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(data[i * 32 : (i + 1) * 32], schema).coalesce(1).write.mode("append").parquet(source)
    for semantics in ("DelayedQuantitative", "DelayedQualitative", "EagerQualitative", "Rosi"):
        monitor = Monitor("G[0,3](x > -2 -> F[0,2](y > 0))", semantics)
        for _ in range(2):  # the second run goes on from the checkpoint, and has nothing to add
            stream = monitor.stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), log=True)
            out = stream.writeStream.format("parquet").option("path", str(tmp_path / f"out{semantics}")).option("checkpointLocation", str(tmp_path / semantics))
            out.trigger(availableNow=True).start().awaitTermination()
        log = monitor.emissions(spark.createDataFrame(data, schema))
        got = spark.read.schema(log.schema).parquet(str(tmp_path / f"out{semantics}"))
        assert rows(got) == rows(log) != []
        local = Monitor("G[0,3](x > -2 -> F[0,2](y > 0))", semantics)
        want, was = [], {}
        for _, s, t, v, _ in (r for r in data if r[0] == "tr0"):
            for k, o in local.update(s, v, t / 1e6).raw_outputs():
                if semantics != "Rosi" or was.get(k) != o:  # intervals that stay are not in the log
                    want.append((k, o))
                was[k] = o
        mine = sorted(log.where("trace = 'tr0'").collect(), key=lambda r: r.seq)
        assert [(r.t / 1e6, r.value if "value" in log.columns else (r.lo, r.hi)) for r in mine] == want


@pytest.mark.parametrize("semantics", ["DelayedQuantitative", "DelayedQualitative", "EagerQualitative", "Rosi"])
def test_log_of_a_table_is_what_comes_sample_by_sample(spark, semantics):
    rnd = random.Random(semantics)
    for names in ("x", "xy"):
        data = samples(spark, rnd, names, traces=2, n=30).cache()
        taken = sorted((r.t, r.signal, r.value) for r in data.where("trace = 'tr1'").collect())
        for k in range(4):
            f = formula(rnd, 2, names)
            f = f & parse_stl("true") if k == 0 else f
            local, want, was = Monitor(f, semantics), [], {}
            for t, s, v in taken:
                for u, o in local.update(s, v, t / 1e6).raw_outputs():
                    if was.get(u) != o:
                        want.append((t, len(want) + 1, round(u * 1e6), *(o if semantics == "Rosi" else (o,))))
                    was[u] = o
            got = Monitor(f, semantics).emissions(data).where("trace = 'tr1'").orderBy("seq")
            assert [tuple(r)[1:] for r in got.collect()] == want, str(f)
            if len(names) == 1 and semantics != "Rosi":
                assert "Python" not in Monitor("G[0,3](x > 0)", "DelayedQuantitative").emissions(data)._jdf.queryExecution().executedPlan().toString()


def test_sources(spark, tmp_path):
    path = str(tmp_path / "signal.csv")
    with open(path, "w") as f:
        f.write("timestep,value\n0,1.5\nbad,row\n2,3\n")
    assert rows(signals.read_csv(spark, path).select("t", "value")) == [(0, 1.5), (2_000_000, 3.0)]
    chirp = signals.chirp(spark, 100, traces=2)
    assert chirp.count() == 200 and chirp.agg(F.max(F.abs("value"))).first()[0] <= 1
    wide = spark.createDataFrame([("w", 1, 1.0, None), ("w", 2, 2.0, 5.0)], "trace string, t long, x double, y double")
    assert signals.from_wide(wide, ["x", "y"]).count() == 3
    log = spark.createDataFrame([("a", 1, 1, 0, -1.0), ("a", 2, 2, 0, -2.0), ("a", 2, 3, 1, 4.0)], "trace string, emitted_at long, seq long, t long, value double")
    assert rows(signals.latest(log)) == [(0, "a", -2.0), (1, "a", 4.0)] and signals.nested(log).count() == 2
    signals.write(log, str(tmp_path / "verdicts"))
    assert spark.read.parquet(str(tmp_path / "verdicts")).count() == 3
    assert signals.gaps(samples(spark, random.Random(1))).count() == 4


def test_parser_forms():
    same = [("x > 5 && y < 3", "x > 5 and y < 3"), ("x>1 || x<0", "x > 1 or x < 0"), ("!(x>1)", "not(x > 1)"), ("globally[0,5](x>1)", "G[0, 5](x > 1)"), ("eventually[0,5](x>1)", "F[0,5] x > 1"), ("x>1 U[0,2] x>2", "x > 1 until[0,2] (x > 2)"), ("x>0 -> x>1 -> x>2", "x>0 implies (x>1 implies x>2)"), ("x > $A", "x > A"), ("x>1 or x>2 and x>3", "x>1 or (x>2 and x>3)")]
    for a, b in same:
        assert parse_stl(a) is parse_stl(b)
    for bad in ("", "x >", "G(x > 1)", "G[0,5", "x > 1 )", "G[5,1](x>1)", "G[-1,2](x>0)", "x ? 1", "> 5"):
        with pytest.raises(StlParseError, match="position"):
            parse_stl(bad)
    assert parse_stl("G > 5").get_signal_identifiers() == ["G"]
    for bad in ("G > 5", "x > 1 and until < 2", "not (or > 1)"):
        with pytest.raises(StlParseError):
            parse_stl(bad, strict=True)
    assert normalize(parse_stl("x > 0 -> x > 1")) is parse_stl("!(x > 0) or x > 1")
    assert parse_stl("G[0,2.5](x > 3)").get_signal_identifiers() == ["x"] and parse_stl("x > $b").get_variable_identifiers() == ["b"]


@pytest.mark.parametrize("synchronization", ["ZeroOrderHold", "Linear", "None"])
@pytest.mark.parametrize("semantics", ["DelayedQuantitative", "DelayedQualitative", "Rosi"])
def test_buckets_are_the_whole_trace(spark, synchronization, semantics):
    rnd = random.Random(f"{synchronization} {semantics}")
    data = samples(spark, rnd, "xyz", traces=3).cache()
    for k in range(3):
        f = formula(rnd, 2, "xy")
        f = Formula.eventually(0, 2, f)
        options = {"closure": "frontier"} if k == 1 else {"grid": "all"} if k == 2 else {}
        want = rows(planner.verdicts(data, f, semantics, synchronization, strategy="kernel", **options))
        for strategy in ("window", "kernel"):
            assert rows(planner.verdicts(data, f, semantics, synchronization, bucket=f.depth / 1e6 + k, strategy=strategy, **options)) == want, str(f)


def test_late_samples_are_dropped_in_pieces(spark):
    rnd = random.Random(21)
    data = [(f"tr{k % 2}", rnd.choice("xy"), i * 1000 - rnd.choice([0, 0, 0, 3000, 50_000]), float(i), i) for k in range(4) for i in range(200)]
    frame = spark.createDataFrame(data + [("tr0", "x", 10**9, 1.0, None)], SCHEMA + ", arrival_seq long")
    want = rows(sync.drop_late(frame))
    assert 0 < len(want) < len(data)
    for run in (1, 7, 64, 10_000):
        assert rows(sync.drop_late(frame, run)) == want
    f = parse_stl("G[0,0.01](x > 3 or y > 5)")
    assert rows(planner.verdicts(frame, f, bucket=0.05, arrivals=16)) == rows(planner.verdicts(frame, f)) != []


def test_a_hot_trace_of_two_signals_is_spread_over_tasks(spark):
    data = spark.range(12_000).selectExpr("if(id % 3 > 0, 'hot', concat('t', id % 100)) as trace", "if(id % 2 = 0, 'x', 'y') as signal", "id * 1000000 as t", "cast(id % 7 as double) as value")
    f = parse_stl("G[0,10](x > 0 -> F[0,5](y > 3))")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for semantics in ("DelayedQuantitative", "Rosi"):
            for strategy in ("window", "kernel"):
                df = planner.verdicts(data, f, semantics, bucket=100.0, strategy=strategy)
                tasks = df.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("trace") == "hot").alias("n")).where("n > 0").collect()
                assert len(tasks) > 3 and max(r.n for r in tasks) < 3000
                assert rows(df) == rows(planner.verdicts(data, f, semantics))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_traces_at_a_time_are_each_by_itself(spark, monkeypatch):
    rnd = random.Random(22)
    data = samples(spark, rnd, "xy", traces=9, n=12).withColumn("t", F.col("t") + F.when(F.col("trace") == "tr3", 10**17).otherwise(1_700_000_000_000_000)).cache()
    for semantics in ("DelayedQuantitative", "DelayedQualitative", "Rosi", "EagerQualitative"):
        for _ in range(2):
            f = formula(rnd, 2, "xy")
            want = rows(planner.verdicts(data, f, semantics, strategy="kernel"))
            for size in (1, 30):
                monkeypatch.setattr(planner, "KERNEL_ROWS", size)
                assert rows(planner.verdicts(data, f, semantics, strategy="kernel")) == want, str(f)
            monkeypatch.setattr(planner, "KERNEL_ROWS", 1 << 18)
            one = [r for k in range(9) for r in rows(planner.verdicts(data.where(f"trace = 'tr{k}'"), f, semantics, strategy="window"))]
            assert sorted(one, key=str) == want, str(f)
    monkeypatch.setattr(planner, "AXIS", 1 << 40)
    assert rows(planner.verdicts(data, f, semantics, strategy="kernel")) == want


def test_clustered_steps_of_a_timeline_cost_no_more_than_even_ones(spark):
    import time

    n = 20_000
    data = spark.range(n).selectExpr("concat('tr', id % 50) as trace", "'x' as signal", "id * 1000000 as t", "cast(id % 9 as double) as value")
    even = spark.range(n).selectExpr("id * 1000000 as t", "'limit' as name", "cast(id % 5 as double) as value")
    clustered = spark.range(n).selectExpr("if(id = 0, 0L, 10000000000L + id) as t", "'limit' as name", "cast(id % 5 as double) as value")
    f = parse_stl("x > $limit")
    took = {}
    for name, timeline in (("warm", even), ("even", even), ("clustered", clustered)):
        began = time.perf_counter()
        df = planner.verdicts(data, f, timeline=timeline)
        assert df.count() == n
        took[name] = time.perf_counter() - began
    assert took["clustered"] < 3 * took["even"] + 1
    late = planner.verdicts(data, f, timeline=clustered).where("t > 10000020000").agg(F.countDistinct(F.col("value") - F.col("t") / 1_000_000 % 9).alias("n")).first().n
    assert late == 1  # all samples after the cluster see its last step


def test_equal_times_of_one_signal_and_what_needs_no_trace(spark):
    rnd = random.Random(31)
    data = spark.createDataFrame([(f"tr{rnd.randrange(3)}", "x", rnd.randrange(30) * 500_000, float(rnd.randint(-3, 3))) for _ in range(200)], SCHEMA).cache()
    for text in ("G[0,2](x > 0)", "F[1,2](x > 1)", "x > 0 U[0,3] x > 1", "x > 1 and x < 3"):
        f = parse_stl(text)
        want = rows(planner.verdicts(data, f, strategy="window"))
        assert want == rows(planner.verdicts(data, f, strategy="kernel")) == rows(planner.verdicts(data, f, strategy="naive"))
        assert want == rows(planner.verdicts(data, f, strategy="kernel", bucket=5.0))
    assert "Window" not in planner.verdicts(data, parse_stl("x > 1 and x < 3"))._jdf.queryExecution().optimizedPlan().toString()


def test_strategy_goes_by_the_rows_of_frames(spark):
    data = spark.range(2000).selectExpr("concat('t', id % 4) as trace", "'x' as signal", "(id div 4) * 1000000 as t", "cast(id % 7 as double) as value")
    f = parse_stl("G[0,10](x > 0)")
    assert abs(planner.frame_rows(data, f, ["x"]) - 10) < 0.1 and planner.frame_rows(data.where("false"), f, ["x"]) == 0
    python = lambda text, **options: "InArrow" in planner.verdicts(data, parse_stl(text), **options)._jdf.queryExecution().executedPlan().toString()
    assert python("G[0,10](x > 0)", per_second=2.0) and not python("G[0,100](x > 0)", per_second=0.1)
    assert not python("G[0,10](x > 0)") and python("G[0,100](x > 0)") and not python("G[0,100](x > 0)", strategy="window") and python("x > 0 U[0,1] x > 1")


def test_predicates_over_expressions(spark):
    rnd = random.Random(41)
    data = samples(spark, rnd, "xy").cache()
    doubled = data.where("signal = 'x'").withColumn("value", F.col("value") * 0.5)
    half = Formula.pred("x * 0.5", ">", 1)
    assert half is Formula.pred(" x  *  0.5", ">", 1.0) and half.bases() == ["x"] and str(half) == "x * 0.5 > 1"
    for semantics in ("DelayedQuantitative", "DelayedQualitative", "Rosi", "EagerQualitative"):
        for strategy in ("window", "kernel"):
            got = planner.verdicts(data, Formula.always(0, 2, half), semantics, strategy=strategy)
            assert rows(got) == rows(planner.verdicts(doubled, parse_stl("G[0,2](x > 1)"), semantics)) != []
    both = Formula.pred("abs(x) + case when y > 0 then y else 0 end", ">=", 2)
    assert both.bases() == ["x", "y"]
    aligned = sync.synchronize(sync.wide(sync.drop_late(data), ["x", "y"]), ["x", "y"], "Linear").where("s0 is not null and s1 is not null")
    want = [(r.t, r.trace, abs(r.s0) + max(r.s1, 0.0) - 2) for r in aligned.collect()]
    assert rows(planner.verdicts(data, both, synchronization="Linear")) == sorted(want, key=str)
    f = Formula.eventually(0, 3, both) & parse_stl("x > -1")
    want = rows(planner.verdicts(data, f, strategy="kernel"))
    assert want == rows(planner.verdicts(data, f, strategy="window")) == rows(planner.verdicts(data, f, bucket=5.0)) == rows(planner.verdicts(data, f, bucket=5.0, strategy="kernel"))
    assert Monitor(f).emissions(data).count() <= len(want)
    for bad in (("3 + 4", ">", 1), ("x", "!=", 1)):
        with pytest.raises(ValueError):
            Formula.pred(*bad)
    with pytest.raises(ValueError, match="tables"):
        Monitor(half).update("x", 1, 0)


def _streamed(spark, stream, mode, name, path):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_intervals_stream_as_updates_over_a_restart(spark, tmp_path):
    rnd = random.Random(51)
    data = [(f"tr{k}", "x", t * 1_000_000, float(rnd.randint(-3, 3))) for t in range(24) for k in range(2)]
    monitor, source, out, seen = Monitor("G[0,3](F[0,2](x > 0))", "Rosi"), str(tmp_path / "in"), [], []
    for i in range(3):  # each round is a new run of the query from its checkpoint
        spark.createDataFrame(data[i * 16 : (i + 1) * 16], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        written = str(tmp_path / f"out{i}")
        stream = monitor.stream(spark.readStream.schema(SCHEMA).parquet(source))
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True)
        query.foreachBatch(lambda df, n, to=written: df.write.mode("append").parquet(f"{to}/{n}")).start().awaitTermination()
        out.append(spark.read.parquet(f"{written}/*").collect())
    for batch in out:
        seen.append({(r.trace, r.t): (r.lo, r.hi) for r in batch})
    last = seen[0] | seen[1] | seen[2]
    want = {(r.trace, r.t): (r.lo, r.hi) for r in monitor.evaluate(spark.createDataFrame(data, SCHEMA)).collect()}
    assert last == want
    assert all(seen[1][k] != seen[0][k] for k in seen[1].keys() & seen[0].keys())  # only what changed comes again


def test_changes_of_a_variable_are_for_later_samples(spark, tmp_path):
    rnd = random.Random(52)
    data = [(f"tr{k}", "x", t * 1_000_000, float(rnd.randint(-3, 3))) for t in range(30) for k in range(2)]
    steps = [(f"tr{k}", "$limit", t * 1_000_000, float(v)) for k in range(2) for t, v in ((0, 1), (9 + k, -1), (10 + k, 2), (21, 0))]
    for name, rows_, schema in (("in", data, SCHEMA), ("vars", steps, "trace string, name string, t long, value double")):
        for i in range(2):
            part = [r for r in rows_ if i * 15_000_000 <= r[2] < (i + 1) * 15_000_000]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    monitor = Monitor("G[0,2](x < $limit)")
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    stream = monitor.stream(read("in", SCHEMA), changes=read("vars", "trace string, name string, t long, value double"))
    _streamed(spark, stream, "append", "with_changes", str(tmp_path / "ckpt"))
    timeline = spark.createDataFrame([(a, "limit", t, v) for a, _, t, v in steps], "trace string, name string, t long, value double")
    want = rows(monitor.evaluate(spark.createDataFrame(data, SCHEMA), timeline=timeline))
    assert rows(spark.table("with_changes")) == want != []
    with pytest.raises(ValueError, match="not found"):
        monitor.stream(read("in", SCHEMA))


def test_state_of_dead_traces_expires_and_late_samples_are_counted(spark, tmp_path):
    from vesper.streaming import processor

    data = [("dead", "x", t * 1_000_000, 1.0) for t in range(5)] + [("live", "x", t * 1_000_000, 1.0) for t in range(60)] + [("live", "x", 2_000_000, 5.0)]
    begin = 1_700_000_000_000_000
    source, path = str(tmp_path / "in"), str(tmp_path / "ckpt")
    for i in range(4):
        part = [(a, s, begin + t, v) for a, s, t, v in data if i * 15_000_000 <= t < (i + 1) * 15_000_000]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    monitor = Monitor("G[0,3](x > 0)")
    stream = monitor.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), expire="20 seconds")
    _streamed(spark, stream, "append", "expiring", path)
    assert [tuple(r) for r in processor.states(spark, path).select("trace", "late").collect()] == [("live", 1)]
    assert processor.states(spark, path).first().samples <= 5
    got = spark.table("expiring").groupBy("trace").count().orderBy("trace").collect()
    assert [tuple(r) for r in got] == [("dead", 2), ("live", 57)]


def test_thresholds_that_change_in_the_kernel(spark):
    rnd = random.Random(61)
    data = samples(spark, rnd, "xy").cache()
    steps = [(rnd.randrange(0, 60) * 700_000, rnd.choice(["limit", "floor"]), float(rnd.randint(-2, 2))) for _ in range(40)]
    timeline = spark.createDataFrame(steps, "t long, name string, value double")
    by_trace = timeline.crossJoin(data.select("trace").distinct())
    for text in ("G[0,2](x > $limit or y < $floor)", "F[0,3](x > $limit) and x < 3", "(x < $limit) U[0,3] (y > $floor)", "x > $limit"):
        f = parse_stl(text)
        for semantics in ("DelayedQuantitative", "DelayedQualitative", "Rosi", "EagerQualitative"):
            want = rows(planner.verdicts(data, f, semantics, timeline=by_trace, strategy="window"))
            assert want == rows(planner.verdicts(data, f, semantics, timeline=timeline, strategy="kernel")) != []
    fixed = spark.createDataFrame([(0, "limit", 1.0), (0, "floor", -1.0)], "t long, name string, value double")
    for semantics in ("EagerQualitative", "DelayedQuantitative"):
        got = planner.verdicts(data, parse_stl("(x < $limit) U[0,3] (y > $floor)"), semantics, timeline=fixed)
        assert rows(got) == rows(planner.verdicts(data, parse_stl("(x < 1) U[0,3] (y > -1)"), semantics))


def test_formulas_together_as_one_by_one(spark):
    rnd = random.Random(12)
    rows = samples(spark, rnd, traces=9, n=60)
    rows = rows.union(rows.limit(20)).union(spark.createDataFrame([("odd", "x", 5, None), (None, "x", 5, 1.0), ("odd", "y", 9, 1.0)], SCHEMA))
    several = [(i, formula(rnd, i % 4)) for i in range(1, 16)] + [(16, Formula.always(0, 10**9, Formula.gt("x", 0.0)))]
    got = {r.formula: tuple(r)[1:] for r in planner.summaries(rows, several).collect()}
    for i, f in several:
        assert got[i] == tuple(planner.verdicts(rows, f, strategy="kernel").agg(F.count("*"), F.min("value"), F.max("value")).first())
    assert got[16] == (0, None, None) and sum(n for n, _, _ in got.values()) > 100
    assert {tuple(r)[1:] for r in planner.summaries(rows.limit(0), several).collect()} == {(0, None, None)}
    with pytest.raises(ValueError, match="same one signal"):
        planner.summaries(rows, [(1, Formula.gt("x", 0.0)), (2, Formula.gt("y", 0.0))])


def test_daily_tasks_grow_with_the_rows_and_are_dealt_once(spark, monkeypatch):
    table = spark.range(3000).selectExpr("id % 40 as k", "date_add(date'2024-01-01', cast(id % 90 as int)) as d", "id * 0.5 as v")
    few = signals.daily(table, "k", "d", "v", "x")
    monkeypatch.setattr(signals, "TASK_ROWS", 100)
    rows = signals.daily(table, "k", "d", "v", "x")
    assert rows.rdd.getNumPartitions() == 30 and sorted(rows.collect()) == sorted(few.collect())
    for strategy in ("window", "kernel"):
        made = planner.verdicts(rows, parse_stl("G[0,172800](x < 100)"), strategy=strategy, dealt=True)
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        assert sorted(made.collect()) == sorted(planner.verdicts(few, parse_stl("G[0,172800](x < 100)"), strategy=strategy).collect()) != []
