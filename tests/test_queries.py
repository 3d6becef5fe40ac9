"""Every registered engine query against its SQL."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from vesper import registry
from vesper.plans import catalog, planner
from vesper.sources import signals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    if name not in registry.oracle_sql():
        assert got
        return
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    at = sorted(range(len(names)), key=names.__getitem__)
    assert columns == sorted(names) and got == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=str)


def test_catalog_over_a_chirp_is_as_by_definition(spark):
    """The published signal: all benchmark formulas, by the kernel and by the definition."""
    rows = signals.chirp(spark, 2500).cache()
    kinds = ("kernel", "naive")
    made = [[planner.verdicts(rows, f, strategy=s).agg(F.count("*").alias("n"), F.round(F.min("value"), 6), F.round(F.max("value"), 6)) for s in kinds] for _, f in catalog.get_formulas()]
    got = [[tuple(x.first()) for x in pair] for pair in made]
    assert len(got) == 21 and all(a == b and a[0] > 0 for a, b in got)


def test_late_rows_are_dropped_and_common_times_are_met(spark):
    every = registry.queries()["atom_gt"](spark, SF).count()
    assert 0 < registry.late_drop(spark, SF).count() < every - 50
    assert registry.sync_none_and(spark, SF).count() > 20
