"""Connected components of a link table, by DataFrame rounds; nothing is gathered on the driver but a count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars over what each batch of links joins: at most as many links out as in, and no long chains within a batch."""
    for batch in batches:
        ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at.reshape(ends.shape)
        root = np.arange(nodes.size)
        while True:  # hooking and pointer jumping
            low = np.minimum(root[a], root[b])
            was = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while not np.array_equal(root, root[root]):
                root = root[root]
            if np.array_equal(root, was):
                break
        keep = root != np.arange(nodes.size)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link to another, as a kept table; root is the least node of its component.

    ``links`` has long columns a, b. Each round hangs a node's neighbours on the least of them
    (the neighbours that are greater, then those that are not), after links within a task have become stars;
    the rounds are logarithmic in a component's size. Sums are pre-aggregated, so a node with a third of all
    links costs a row per task.
    """
    now = links.where("a <> b").select("a", "b")
    now = frames.keep(now.mapInArrow(_forest, "a long, b long").distinct(), "links")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: greater neighbours go to the least of the neighbourhood. now holds a > b.
        large = now.select(F.col("b").alias("a"), F.col("a").alias("x")).join(least, "a").select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b")
        hung = large.union(least.where("a <> m").select("a", F.col("m").alias("b")))
        # Small star: a node and its lesser neighbours go to the least of them.
        small = hung.groupBy("a").agg(F.min("b").alias("m"))
        low = hung.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turned = low.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        was, now = now, frames.keep(turned.union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        frames.drop(was)
        counts = now.agg(F.count("*"), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if counts == before or counts[0] == 0:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots.kept_at = now.kept_at
            return roots
        before = counts
