"""Mixing sources to target weights by Poisson replication.

A source of ``size`` characters and target weight w repeats at the mean rate w * total / size. Each document's
number of copies is the inverse of that Poisson distribution at a uniform number hashed from the seed and its
doc_id; the document is exploded by it, and copies are shuffled globally: dealt to partitions by a hash of seed,
doc_id and copy, and sorted by it within each. Built-in functions only.

The distribution of a source is the cumulative probabilities of the counts within 12 standard deviations (and 20) of its
rate; what lies outside is below 1e-30. They are rows until they are summed, each by itself from Stirling's series in
deviance form, so that neither high rates underflow nor one source costs more than the root of its rate. A source has a high
rate only if it has few characters, so its documents are few. Copies are numbered in blocks of BLOCK. Sizes are pre-aggregated and kept
as a small table; Spark broadcasts it only when its files are under spark.sql.autoBroadcastJoinThreshold, and else splits hot sources.

Defined results: a null source is a source of its own; a source without characters repeats at rate 1; a null
doc_id is hashed as the word null; repeated rows get equal numbers of copies; an empty table gives an empty table.
Columns copy and shuffle_key are added (and replace any of that name); all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import frames

#: Copies of a document that are numbered at a time.
BLOCK = 1 << 16
#: 13 hex digits of a digest are 52 bits: they are exact as a double.
DIGITS, SPAN = 13, float(1 << 52)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a digest of the seed and the parts."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, DIGITS), 16, 10).cast("double") / F.lit(SPAN)


def probability(rate: Column, k: Column) -> Column:
    """The Poisson probability of k at a rate above 0."""
    x = k.cast("double")
    few = F.exp(x * F.log(rate) - rate) / F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double")
    series = F.lit(1 / 12) / x - F.lit(1 / 360) / F.pow(x, 3) + F.lit(1 / 1260) / F.pow(x, 5) - F.lit(1 / 1680) / F.pow(x, 7)
    many = F.exp(x - rate - x * F.log(x / rate) - series) / F.sqrt(2 * F.pi() * x)
    return F.when(k <= 20, few).otherwise(many)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, rest: float = 1.0, seed: int = 17) -> DataFrame:
    """docs replicated so that sources' shares of the characters go as their weights (``rest`` for those not named)."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # whatever the columns are called, these and the operator's own don't clash
    docs = docs.toDF(*plain)
    doc_id, source, said = (plain[names.index(n)] for n in ("doc_id", "source", "text"))

    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(said), F.lit(0)).cast("long")).alias("size"))
    weight = F.lit(float(rest))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sizes = frames.keep(sizes.withColumn("weight", weight), "sizes")
    total, all_weights = sizes.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.when(F.col("size") > 0, F.col("weight") / F.lit(float(all_weights or 1)) * F.lit(float(total or 0)) / F.col("size")).otherwise(F.lit(1.0))
    reach = 12 * F.sqrt("rate") + 20
    rates = sizes.select("source", rate.alias("rate")).withColumn("low", F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("long"))
    counts = rates.where("rate > 0").withColumn("k", F.explode(F.sequence("low", F.ceil(F.col("rate") + reach).cast("long"))))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("upto", F.sum(probability(F.col("rate"), F.col("k"))).over(upto))
    # A source of rate 0 has no row here, and so no copies.
    rates = frames.keep(summed.groupBy("source", "low").agg(F.sort_array(F.collect_list("upto")).alias("sums")), "rates")

    drawn = docs.join(rates, docs[source].eqNullSafe(rates["source"])).withColumn("u", uniform(seed, F.col(doc_id)))
    drawn = drawn.withColumn("n", F.col("low") + F.size(F.filter("sums", lambda s: s <= F.col("u")))).where("n > 0").select(*plain, "n")
    blocks = drawn.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("long"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least("n", (F.col("block") + 1) * BLOCK))))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    dealt = copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    kept = [F.col(p).alias(n) for p, n in zip(plain, names, strict=True) if n not in ("copy", "shuffle_key")]
    return dealt.select(*kept, "copy", "shuffle_key")


#: The same by DuckDB: all sources at equal weights, seed 17.
ORACLE = r"""
with sizes as (select source, sum(coalesce(length(text), 0)) as size from documents group by source),
rates as (select source, case when size > 0 then (1.0::double / (select count(*) from sizes)) * (select sum(size) from sizes)::double / size else 1.0 end as rate from sizes),
probs as (
  select source, k, sum(exp(k * ln(rate) - rate - case when k > 1 then lgamma(k + 1) else 0 end)) over (partition by source order by k) as upto
  from (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::bigint + 1)) as k from rates)
), drawn as (
  select d.*, ('0x' || substr(md5('17:' || d.doc_id), 1, 13))::bigint::double / 4503599627370496.0 as u from documents d
), counted as (
  select d.doc_id, count(*) as n from drawn d join probs p on d.source is not distinct from p.source and p.upto <= d.u group by d.doc_id
)
select d.*, i.copy as copy, md5('17:order:' || d.doc_id || ':' || i.copy) as shuffle_key
from documents d join counted c using (doc_id), unnest(range(1, c.n + 1)) as i(copy)
"""
