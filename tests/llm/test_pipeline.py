"""The pipeline's stages against brute force on small tables, and run() against its stages."""

import re

import numpy as np
import public_tokenizers

import corpus_pipeline as P
from tests.llm import hard
from tests.llm.test_jaccard import brute as components
from tests.llm.test_line_dedup import brute as left
from vesper.llm import jaccard, mixing, quality_model

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_by_brute_force(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_lines", "mixed", "packed"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.quality(spark, docs, SF)
    assert first.columns == list(P.COLUMNS)
    scores = {r.doc_id: r.score for r in quality_model.score(docs, quality_model.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert rows(first.select("doc_id")) == sorted(((d,) for d, s in scores.items() if s >= 0.3), key=str)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert np.mean([d in kept for d, y in labels.items() if y]) > 0.97

    second = P.near_duplicates(spark, first, SF)
    ids = [tuple(r) for r in first.select("doc_id", "text").collect()]
    assert rows(second.select("doc_id")) == sorted(((d,) for d, n, c in components(ids, 5, 80) if n == 0 or d == c), key=str)

    third = P.repeated_lines(spark, second, SF)
    want = [(d, t) for d, t, _ in left([tuple(r) for r in second.select("doc_id", "text").collect()], 4)]
    assert rows(third.select("doc_id", "text")) == sorted(want, key=str) and rows(third.where("n_chars <> length(text)")) == []

    fourth = P.mixed(spark, third, SF)
    assert fourth.columns == list(P.COLUMNS)
    assert rows(fourth) == rows(mixing.mix(third).select(*P.COLUMNS))

    last = P.packed(spark, fourth, SF).collect()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in last) == sum(len(encode.encode(r.text or "").ids) + 1 for r in fourth.collect())
    assert sorted(tuple(r)[:5] for r in P.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in last)


def test_hard_rows(spark, tmp_path):
    docs = hard.documents(spark)
    spark.createDataFrame([(1, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, hard.empty(spark)):
        for name, stage in P.STAGES:
            table = stage(spark, table, str(tmp_path))
            if name != "packed":
                assert table.columns == list(P.COLUMNS), name
        table.collect()


def test_one_of_each_group_stays(spark):
    docs = hard.documents(spark)
    kept = [r.doc_id for r in P.near_duplicates(spark, docs, "").collect()]
    texts = dict(docs.select("doc_id", "text").collect())
    assert {2, 3, 4} <= set(kept) and 8 not in kept and 11 not in kept and kept.count(1) == 2  # repeated rows are one document
    assert all(re.search(r"[^\s]", texts[d] or "") is None or d in (None, 1, 5, 6, 7, 9, 10, 12, 13, 14) for d in kept) and jaccard.NOBODY not in kept


def test_copies_without_or_with_the_same_doc_id(spark):
    said = [f"number {i} of the texts has words of its own {i * 7} and {i * 13} more of them {i}" for i in range(6)]
    table = [(None, said[0]), (None, said[0]), (None, said[0].upper()), (None, said[1]), (1, said[1]), (2, said[2]), (3, said[3]), (3, said[2]), (4, said[4]), (4, said[4] + " "), (None, said[5]), (5, ""), (6, None)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in table], hard.SCHEMA)
    got = [(r.doc_id, (r.text or "").strip().lower()) for r in P.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(None, said[0]), (1, said[1]), (2, said[2]), (3, said[3]), (4, said[4]), (None, said[5]), (5, ""), (6, "")], key=str)
