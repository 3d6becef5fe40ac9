import zlib

import numpy as np
import pyarrow as pa

from tests.llm import hard
from vesper.llm import labelled, quality_model, queries, text

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op3_quality_classifier(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.93


def test_table_scores_as_the_vectors_do():
    rng = np.random.default_rng(0)
    model = quality_model.Model(rng.normal(size=(quality_model.BUCKETS, quality_model.SIZE)).astype(np.float32), rng.normal(size=(2, quality_model.SIZE)).astype(np.float32), 0.5)
    data, offs = text.of_column(pa.array([t for _, t in hard.TEXTS], pa.string()))
    fast = quality_model.logits(model.table(), data, offs)
    for (_, t), got in zip(hard.TEXTS, fast, strict=True):
        buckets, shares = quality_model.features(t or "")
        scores = model.output @ (shares @ model.vectors[buckets]) if buckets.size else np.zeros(2)
        assert abs(scores[1] - scores[0] - got) < 1e-3


def test_learned_rows_are_bounded_and_outside_the_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    sample = labelled.draw(docs, labels, "quality", 5, 0, 30, 1 << 20)
    assert np.bincount(sample.labels).max() <= 30 and sum(len(t.encode()) for t in sample.texts) <= 1 << 20
    held = {r.text for r in docs.where(labelled.remainder(5) == 0).collect()} - {r.text for r in docs.where(labelled.remainder(5) != 0).collect()}
    assert not held & set(sample.texts)


def test_hard_rows(spark):
    docs, labels = hard.documents(spark), spark.createDataFrame([(1, 1, 0), (12, 0, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality_model.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in quality_model.judge(docs, none).collect()} == {0.5}
    assert quality_model.judge(hard.empty(spark), labels).collect() == []


def test_long_texts_fill_what_the_budget_has_left(spark):
    said = [" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((20, 30, 400, 500, 9000))]
    said.append(said[2] + " and its near copy")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(said)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (0, 1, 2, 3, 4, 5, 9)], "doc_id long, quality int")
    sample = labelled.draw(docs, labels, "quality", 5, -1, 30, 10_000)
    assert len(said[2]) > 100 and sorted(sample.texts) == sorted(said[:4])
