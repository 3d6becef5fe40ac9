"""A bounded sample of labelled documents, drawn the same way at every size, for models that are fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text


def remainder(mod: int):
    """crc32 of doc_id as text, modulo mod: what folds are told by."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod).cast("int")


@dataclass
class Sample:
    texts: list[str]
    labels: np.ndarray
    #: What each row stands for among all labelled rows of its class.
    weights: np.ndarray

    @property
    def prior(self) -> float:
        """Share of label 1 among the rows that the sample was drawn from, smoothed."""
        ones, total = self.weights[self.labels == 1].sum(), self.weights.sum()
        return float((ones + 1) / (total + 2))


def draw(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int, max_bytes: int) -> Sample:
    """At most ``per_class`` rows of each label whose fold isn't ``held``, by hash of doc_id, and at most ``max_bytes`` of text.

    No more than four times ``max_bytes`` of text come to the driver at once, and rows of one doc_id and text come once.
    Copies, and near copies that share one of four shingle minima, count once, so that no text is learned by heart.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(remainder(mod) != held)
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    sizes = dict(rows.groupBy("y").count().collect())
    picked = [rows.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    picked = picked[0].union(picked[1])  # 2 * per_class rows at most
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # Longest texts are left to the end of the budget. Only lengths come at first, one for each text; then texts by length, as far as they fit.
    found = found.where("text is not null").withColumn("size", F.octet_length("text")).groupBy("doc_id", "y", "h", F.xxhash64("text").alias("as")).agg(F.min("text").alias("text"), F.min("size").alias("size"))
    sizes_of = found.groupBy("size").count().collect()  # as many rows as there are lengths
    lengths = sorted(r["size"] for r in sizes_of for _ in range(min(r["count"], 2 * per_class)))
    texts, ys, seen, size = [], [], set(), 0

    def learn(rows) -> None:
        nonlocal size
        for r in rows:
            raw = pa.array([r.text], pa.string())
            data, offs = text.of_column(raw)
            if size + data.size > max_bytes:
                continue
            starts, ends, first = text.word_spans(data, offs)
            grams, _ = text.windows(text.hash_spans(data, starts, ends), first, 5, short=True)
            marks = {(i, int(text.mix(grams ^ np.uint64(i * 0x9E3779B9)).min())) for i in range(4)} if grams.size else {(-1, 0)}
            if marks & seen:
                continue
            seen.update(marks)
            size += data.size
            texts.append(r.text or "")
            ys.append(r.y)

    short = [n for n in lengths if n <= max_bytes // 100]
    fit = int(np.searchsorted(np.cumsum(short), 4 * max_bytes, side="right"))  # copies, which aren't learned, need some room too
    if fit:
        rows = found.where(F.col("size") <= short[fit - 1]).orderBy("h", "doc_id", "as").limit(fit).collect()
        learn(sorted(rows, key=lambda r: (r.h, r.doc_id, r.text)))
    long = [n for n in lengths if n > (short[fit - 1] if fit else 0)]
    while long:  # again if copies left room
        fit = int(np.searchsorted(np.cumsum(long), max_bytes - size, side="right"))
        if not fit:
            break
        rows = found.where(F.col("size").between(long[0], long[fit - 1])).orderBy("size", "h", "doc_id", "as").limit(fit).collect()
        learn(sorted(rows, key=lambda r: (r.size, r.h, r.doc_id, r.text)))
        long = [n for n in long if n > long[fit - 1]]
    y = np.array(ys, dtype=np.int64)
    count = np.bincount(y, minlength=2)
    each = np.array([sizes.get(c, 0) / max(1, count[c]) for c in (0, 1)])
    return Sample(texts, y, each[y] if y.size else np.zeros(0))
