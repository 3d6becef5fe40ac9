import math

from pyspark.sql import functions as F

from tests.llm import duck, hard
from vesper.llm import mixing, queries


def test_as_sql(spark):
    assert duck.frame_rows(queries.op6_mixing_sources(spark, "/root/testdata/sf0.001")) == duck.rows(mixing.ORACLE)


def test_shares_go_to_the_weights(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "'some text' as text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', null)) as source", "id as copy")
    done = mixing.mix(docs, {"a": 4.0}, rest=1.0)
    n = dict(done.groupBy("source").count().collect())
    for source, share in (("a", 4 / 6), ("b", 1 / 6), (None, 1 / 6)):
        assert abs(n[source] - 40_000 * share) < 6 * math.sqrt(40_000 * share)
    assert sorted(set(done.columns)) == ["copy", "doc_id", "shuffle_key", "source", "text"]


def test_high_rates_do_not_underflow(spark):
    docs = spark.createDataFrame([(1, "x", "tiny"), (2, "y" * 4000, "large")], "doc_id long, text string, source string")
    n = dict(mixing.mix(docs).groupBy("source").count().collect())
    assert 1700 < n["tiny"] < 2300


def test_hard_rows(spark):
    docs = hard.documents(spark)
    done = mixing.mix(docs)
    assert set(done.columns) == set(docs.columns) | {"copy", "shuffle_key"}
    done.collect()
    assert mixing.mix(hard.empty(spark)).collect() == []


def test_columns_may_have_any_names(spark):
    docs = spark.createDataFrame([(i, "text", f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    for name in ("_sums", "_source", "_u", "_n", "sums", "u", "n", "rate", "low", "c0", "block"):
        docs = docs.withColumn(name, docs["doc_id"])
    done = mixing.mix(docs).toPandas()
    assert set(done.columns) == set(docs.columns) | {"copy", "shuffle_key"}
    assert (done["_u"] == done["doc_id"]).all() and (done["n"] == done["doc_id"]).all()


def test_a_rate_of_a_million(spark):
    docs = spark.createDataFrame([(1, "x", "tiny"), (2, "y" * 2_000_000, "large")], "doc_id long, text string, source string")
    done = mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), F.countDistinct("copy").alias("own"))
    n, lo, hi, own = done.where("source = 'tiny'").select("n", "lo", "hi", "own").first()
    assert abs(n - 1_000_000) < 6000 and (lo, hi, own) == (1, n, n)


def test_probabilities_are_poisson(spark):
    for rate in (0.01, 1.0, 7.3, 300.0, 2e6):
        at = sorted({max(0, int(rate + d * math.sqrt(rate))) for d in (-5, -1, 0, 1, 5)} | {19, 20, 21})
        rows = spark.createDataFrame([(rate, k) for k in at], "rate double, k long").select("k", mixing.probability(F.col("rate"), F.col("k"))).collect()
        for k, p in rows:
            want = math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            assert abs(p - want) <= 1e-7 * want + 1e-300
