"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ("atom_gt", "globally_quant", "globally_bool", "nested_gf", "response", "until_quant", "rosi_response", "eager_globally", "sync_zoh_windows", "kernel_response", "bucketed", "lineitem_quantity", "orders_price")
RUNS = 3
#: A job takes most of a second to start; so many traces show what samples cost.
SAMPLES, TRACES = 20_000, 200


def chirp_queries() -> dict:
    """The benchmark formulas phi 1 to 4 over chirps of SAMPLES samples, TRACES at a time; and one window at growing bounds."""
    from vesper import parse_stl
    from vesper.plans import planner
    from vesper.sources import signals

    # The published benchmark's formulas.
    formulas = {
        "chirp_phi1": "x < 0.5 and x > -0.5",
        "chirp_phi2": "G[0,1000](x > 0.5 -> F[0,100](x < 0.0))",
        "chirp_phi3": "(x < 0.5) U[0,1000] (x < 0.0)",
        "chirp_phi4": "(G[0,100](x < 0.5)) or (G[100,150](x > 0.0))",
        "chirp_f100": "F[0,100](x < 0.5)",
        "chirp_f5000": "F[0,5000](x < 0.5)",
    }

    def run(text: str):
        return lambda spark, _: planner.verdicts(signals.chirp(spark, SAMPLES, traces=TRACES), parse_stl(text))

    return {name: run(x) for name, x in formulas.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vesper import registry

    known = registry.queries()
    chosen = {n: known[n] for n in HEADLINE} | chirp_queries()
    times = {}
    for name, query in chosen.items():
        best = float("inf")
        for _ in range(RUNS):
            began = time.perf_counter()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    rate = {n: round(TRACES * SAMPLES / t) for n, t in times.items() if n.startswith("chirp")}
    print(json.dumps({"metric": "sum of best times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "samples_per_sec": rate, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
