"""Where signals come from and verdicts go: tables, CSV files, generators, and reports over verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_events(events: DataFrame, signal: str | None = "value", trace: str = "user_id") -> DataFrame:
    """Events as signals by user: one signal, or with None one per event_type; arrival by event_id."""
    name = F.lit(signal) if signal else F.col("event_type")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col(trace).alias("trace"), name.alias("signal"), t.alias("t"), F.col("value").cast("double").alias("value"), F.col("event_id").alias("arrival_seq"))


#: Rows of a table that a task takes of ``daily``.
TASK_ROWS = 1_000_000


def daily(table: DataFrame, trace: str, day: str, value: str, signal: str) -> DataFrame:
    """A signal of sums per trace and day (rounded to cents, so that engines agree).

    It comes dealt by trace (``dealt`` spares a planner's exchange), over as many tasks as hold TASK_ROWS rows of the table each, which is counted for that.
    """
    tasks = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))
    rows = table.select(F.col(trace).alias("trace"), F.col(day).cast("date").alias("day"), F.col(value).cast("double").alias("value")).repartition(tasks, "trace")
    rows = rows.groupBy("trace", "day").agg(F.round(F.sum("value"), 2).alias("value"))
    return rows.select("trace", F.lit(signal).alias("signal"), (F.unix_date("day").cast("long") * F.lit(86_400_000_000)).alias("t"), "value")


def read_csv(spark: SparkSession, path: str, trace: str = "csv", signal: str = "x") -> DataFrame:
    """``timestep,value`` files; malformed rows are dropped."""
    rows = spark.read.csv(path, header=True, schema="timestep double, value double", mode="DROPMALFORMED")
    return rows.where("timestep is not null and value is not null").select(F.lit(trace).alias("trace"), F.lit(signal).alias("signal"), F.round(F.col("timestep") * 1e6).cast("long").alias("t"), "value")


def read_phases(spark: SparkSession, path: str, phases: list[str], columns: list[str]) -> DataFrame:
    """A wide recording (t, phase, one column per signal) as signals, of the given phases."""
    rows = spark.read.csv(path, header=True, inferSchema=True).where(F.col("phase").isin(*phases))
    return from_wide(rows.withColumn("t", F.round(F.col("t") * 1e6).cast("long")), columns)


def from_wide(table: DataFrame, columns: list[str], trace: str = "wide") -> DataFrame:
    who = F.col("trace") if "trace" in table.columns else F.lit(trace)
    rows = table.select(who.alias("trace"), "t", *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.unpivot(["trace", "t"], columns, "signal", "value").where("value is not null")


def sine(spark: SparkSession, n: int, frequency: float, amplitude: float = 1.0, rate: float = 1.0, traces: int = 1) -> DataFrame:
    return _generated(spark, n, rate, traces, lambda t: amplitude * F.sin(2 * F.pi() * F.lit(frequency) * t))


def chirp(spark: SparkSession, n: int, start: float = 0.01, end: float = 0.0001, amplitude: float = 1.0, rate: float = 1.0, traces: int = 1) -> DataFrame:
    """A cosine whose frequency goes linearly from start to end."""
    length = n / rate
    return _generated(spark, n, rate, traces, lambda t: amplitude * F.cos(2 * F.pi() * (F.lit(start) * t + F.lit((end - start) / (2 * length)) * t * t)))


def _generated(spark: SparkSession, n: int, rate: float, traces: int, value) -> DataFrame:
    k, seconds = F.col("id") % n, (F.col("id") % n) / F.lit(rate)
    return spark.range(n * traces).select((F.col("id") / n).cast("long").alias("trace"), F.lit("x").alias("signal"), F.round(k / F.lit(rate) * 1e6).cast("long").alias("t"), value(seconds).alias("value"))


def violated(column: Column, kind: str) -> Column:
    return ~column if kind == "boolean" else column < 0


def report(verdicts: DataFrame) -> DataFrame:
    """Per trace: verdicts, violations, the worst margin (null for truths), and the first violation's time."""
    kind = verdicts.schema["value"].dataType.simpleString()
    bad = violated(F.col("value"), kind)
    worst = F.min("value") if kind == "double" else F.lit(None).cast("double")
    return verdicts.groupBy("trace").agg(F.count("*").alias("verdicts"), F.count_if(bad).alias("violations"), worst.alias("worst"), F.min(F.when(bad, F.col("t"))).alias("first_violation"))


def dataset(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Samples with their verdicts beside them, where there are any."""
    return samples.join(verdicts.withColumnRenamed("value", "verdict"), ["trace", "t"], "left")


def latest(emissions: DataFrame) -> DataFrame:
    """Of an emission log (trace, seq, t, value) the last value for each time."""
    return emissions.groupBy("trace", "t").agg(F.max_by("value", "seq").alias("value"))


def nested(emissions: DataFrame) -> DataFrame:
    """An emission log (trace, emitted_at, seq, t, value) as one row per input step with its outputs."""
    outputs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "t", "value"))), lambda o: F.struct(o["t"].alias("timestamp"), o["value"].alias("value")))
    return emissions.groupBy("trace", "emitted_at").agg(outputs.alias("outputs"))


def write(verdicts: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = verdicts.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)


def gaps(signals: DataFrame) -> DataFrame:
    """Per trace and signal: samples, first and last time, and the widest gap, for choosing windows and buckets."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("trace", "signal").orderBy("t"))
    return signals.withColumn("_step", step).groupBy("trace", "signal").agg(F.count("*").alias("samples"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("_step").alias("widest_gap"))
