import random
import zlib

import numpy as np
import pyarrow as pa

from tests.llm import hard
from vesper.llm import labelled, queries, text, toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.op9_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.93 and sum(p and y for p, y in held) > 0.5 * sum(y for _, y in held)


def test_a_lexicon_is_learned_and_words_are_read_through_disguise():
    rnd = random.Random(2)
    texts, labels = [], []
    for i in range(400):
        words = [f"w{rnd.randrange(500)}" for _ in range(80)]
        if i % 4 == 0:
            words[rnd.randrange(80)] = words[rnd.randrange(80)] = rnd.choice(["Idiot!", "(moron", "1di0t", "m0r0n."])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(labelled.Sample(texts, np.array(labels), np.ones(400)))
    data, offs = text.of_column(pa.array(["you are an 1D10T, really " + "w1 w2 " * 20, "w1 w2 w3 " * 20, ""]))
    scores = model.scores(toxicity.features(data, offs, model.lexicons))
    assert scores[0] > 0.7 > 0.3 > scores[1]
    near = toxicity.features(data, offs, model.lexicons)[:, toxicity.FEATURES.index("hits near you")]
    assert near[0] > 0 == near[1]


def test_isotonic_is_the_best_monotone_fit():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]), np.ones(6))
    assert np.allclose(np.interp([1, 2, 3, 4, 5], x, y), [0, 0.5, 0.5, 0.5, 1])
    assert (np.diff(y) >= 0).all()


def test_hard_rows(spark):
    docs, labels = hard.documents(spark), spark.createDataFrame([(1, 1, 0), (12, 0, 1), (10, 0, 1), (9, 0, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.judge(docs, labels.where("false")).collect()} == {0.5}
    assert toxicity.judge(hard.empty(spark), labels).collect() == []
