"""How the operators read tables, run Arrow kernels and keep what they read twice."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where tables that are read twice go on a single machine whose session names no folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/vesper"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session with all executors on this machine may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("On a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def keep(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there, so a lost executor costs no rerun.

    ``drop`` removes the table once its last reader is done; what a result still reads goes when the session ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/vesper-{what}-{uuid.uuid4().hex}"
    where, system = _located(spark, path)
    release(spark)
    df.write.option("compression", "zstd").parquet(path)
    system.deleteOnExit(where)
    made = spark.read.schema(schema).parquet(path)
    made.kept_at = path
    return made


def drop(*tables: DataFrame) -> None:
    """Removes kept tables; nothing may read them any more."""
    for t in tables:
        where, system = _located(t.sparkSession, t.kept_at)
        system.delete(where, True)


def _located(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done go when the driver collects its garbage; after a table is kept is a good time for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scan(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """kernel over each Arrow batch, by itself: no shuffle, no state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (made := kernel(batch)) is not None:
                yield made
            made = batch = None
            tidy()

    return df.mapInArrow(run, schema)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy() -> None:
    """Gives what a worker has freed back to the system: workers live on between tasks, and an executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else docs holds; doc_id as long, text as string."""
    kinds = {"doc_id": "long", "text": "string"}
    return docs.select(*[F.col(f"`{n}`").cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in names])
