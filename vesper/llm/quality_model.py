"""A supervised subword-embedding classifier of document quality.

A document's features are its words, its word pairs and the character 2-, 3- and 4-grams of its bytes (across spaces,
within the text), each hashed to a bucket with a learned vector. A pair of equal words is one feature, whatever the word. The vectors' mean is the document's; a softmax over two classes reads
it. Vectors and output weights are learned together by numpy stochastic gradient descent, document by document, on
a bounded sample of labelled rows: PER_CLASS rows of each label and MAX_BYTES of text at most. Classes are sampled
evenly, so the logit is then shifted to the shares they have among all labelled rows.

Scoring reads every whole text: with two classes the softmax of a mean is the logistic of the mean of one number
per bucket, so tasks get a table of BUCKETS floats (2 MB), and sums come from prefix sums over the batch's bytes. It is
a narrow scan: no shuffle, nothing grows with the input.

Defined results: a null, empty or wordless text has the score that the prior gives; without labelled rows of both
classes every score is the prior; repeated rows and null doc_ids get rows of their own; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, labelled, text

#: Bounds of the sample that the model is fitted on.
PER_CLASS, MAX_BYTES = 1500, 12 << 20
BITS = 18
BUCKETS = 2 << BITS  # words, then character n-grams
SIZE, EPOCHS, RATE = 8, 5, 0.3
GRAMS = (2, 3, 4)
#: score >= CUT is predicted 1.
CUT = 0.3


def gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; the last n - 1 have none."""
    size = max(0, data.size - n + 1)
    code = np.full(size, n, dtype=np.uint32)
    for j in range(n):
        code *= np.uint32(0x01000193)
        code ^= data[j : j + size]
        code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    return (code >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)


def word_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its bucket and that of the pair it begins (unless it is its text's last), and each text's first word."""
    starts, ends, first = text.word_spans(data, offs)
    hashes = text.hash_spans(data, starts, ends)
    pairs = hashes.copy()
    pairs[:-1] -= hashes[1:]
    pairs = np.where(pairs == 0, np.uint64(0), text.mix(hashes + np.uint64(3) * pairs))
    top = np.uint64(64 - BITS)
    return (hashes >> top).astype(np.int64), (pairs >> top).astype(np.int64), first


def features(said: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and how often it has each, as shares that add up to 1."""
    data, offs = text.of_column(pa.array([said], pa.string()))
    words, pairs, _ = word_buckets(data, offs)
    buckets, counts = np.unique(np.concatenate([words, pairs[:-1], *[gram_buckets(data, n).astype(np.int64) for n in GRAMS]]), return_counts=True)
    return buckets, counts / max(1, counts.sum())


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    #: Added to the logit of class 1.
    shift: float

    def table(self) -> np.ndarray:
        """For each bucket what it adds to the logit, before the mean."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32)


def fit(sample: labelled.Sample, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    output = np.zeros((2, SIZE), dtype=np.float32)
    prior, counts = sample.prior, np.bincount(sample.labels, minlength=2)
    if not counts.all():
        return Model(vectors, output, float(np.log(prior / (1 - prior))))
    shown = [features(t) for t in sample.texts]
    bias = np.log(counts[1] / counts[0])
    steps, done = EPOCHS * len(shown), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(shown)):
            buckets, shares = shown[i]
            rate = RATE * (1 - done / steps)
            done += 1
            if not buckets.size:
                continue
            rows = vectors[buckets]
            mean = shares.astype(np.float32) @ rows
            scores = output @ mean
            scores[1] += bias
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[sample.labels[i]] -= 1
            back = p @ output
            output -= rate * np.outer(p, mean)
            # Normalised by the shares' squares, a step moves a document's mean as far however long it is.
            vectors[buckets] = rows - (rate / (shares @ shares)) * np.outer(shares, back).astype(np.float32)
    return Model(vectors, output, float(np.log(prior / (1 - prior))))


def logits(table: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The mean of the table over each text's features; 0 for a text without any."""
    words, pairs, first = word_buckets(data, offs)
    total, n = np.zeros(offs.size - 1), np.zeros(offs.size - 1)
    for buckets, less in ((words, 0), (pairs, 1)):
        sums = np.zeros(words.size + 1)
        np.cumsum(table[buckets], out=sums[1:])
        end = np.maximum(first[1:] - less, first[:-1])
        total += sums[end] - sums[first[:-1]]
        n += end - first[:-1]
    for k in GRAMS:
        values = table[gram_buckets(data, k)]
        sums = np.zeros(data.size + 1)
        np.cumsum(values, out=sums[1 : values.size + 1])
        end = np.maximum(offs[1:] - k + 1, offs[:-1])
        total += sums[end] - sums[offs[:-1]]
        n += end - offs[:-1]
    return total / np.maximum(n, 1)


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> Model:
    return fit(labelled.draw(docs, labels, "quality", mod, held, PER_CLASS, MAX_BYTES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs."""
    table, shift = model.table(), model.shift

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text.of_column(batch.column("text"))
        found = [logits(table, d, o) for _, _, d, o in text.slices(data, offs)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(found) + shift, -30, 30))))], ["doc_id", "score"])

    return frames.scan(frames.doc_columns(docs, "doc_id", "text"), kernel, "doc_id long, score double")


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, with the score beside them: one scan, no join."""
    table, shift = model.table(), model.shift
    plain = [f"_c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, docs.schema.fields, strict=True))
    said = plain[docs.columns.index("text")]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text.of_column(batch.column(said))
        found = [logits(table, d, o) for _, _, d, o in text.slices(data, offs)]
        score = pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(found) + shift, -30, 30))))
        return pa.RecordBatch.from_arrays([*batch.columns, score], [*plain, "score"])

    made = frames.scan(docs.toDF(*plain), kernel, f"{kinds}, score double")
    return made.select(*[F.col(p).alias(n) for p, n in zip(plain, docs.columns, strict=True) if n != "score"], "score")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; the model is fitted on labelled rows outside the held-out fold."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (labelled.remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
