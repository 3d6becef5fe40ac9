"""A corpus pipeline of five stages, each one of the operators in vesper.llm at its production parameters.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesper.llm import frames, jaccard, line_dedup, mixing, packing, quality_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: How the sources are mixed: all at equal weights of characters.
WEIGHTS: dict[str, float] = {}
END_ID, CAPACITY = 2, 1024


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows outside its held-out fold, doesn't reject."""
    judged = quality_model.annotate(docs.select(*COLUMNS), quality_model.train(docs, frames.table(spark, sf_dir, "labels")))
    return judged.where(F.col("score") >= quality_model.CUT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, 0.8) the document of least doc_id; without shingles, all.

    Documents are told apart by doc_id and text: rows equal in both are one document and all stay, unless without a
    doc_id, when one row stays. Of a component's texts with one doc_id one stays.
    """
    named = docs.select(*COLUMNS).withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    classes = jaccard.join(named.select(F.col("_row").alias("doc_id"), "text"), k=5, percent=80)
    classes = classes.select(F.col("doc_id").alias("_row"), F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("_of")).distinct()
    ids = named.select("_row", F.coalesce(F.col("doc_id").cast("long"), F.lit(line_dedup.LAST)).alias("_at")).distinct()
    least = classes.join(ids, "_row").groupBy("_of").agg(F.min(F.struct("_at", "_row")).alias("least"))
    kept = frames.keep(least.select(F.col("least._row").alias("_row")), "kept")
    stay = named.join(kept, "_row", "left_semi")
    alone = stay.where("doc_id is null").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return stay.where("doc_id is not null").select(*COLUMNS).union(alone.select(*COLUMNS))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document (or line) has."""
    done = line_dedup.dedup(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by a Poisson draw, so that sources come at their weights, in shuffled order."""
    return mixing.mix(docs.select(*COLUMNS), WEIGHTS).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of CAPACITY."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_lines", repeated_lines), ("mixed", mixed), ("packed", packed)]
#: A trained model, shingles joined to a fixed point and tokens are not SQL's; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each one's result written and read again."""
    docs = frames.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = frames.keep(docs, f"stage-{name}")
    return docs
