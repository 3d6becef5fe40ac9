import math
import random
import re
from collections import Counter

import numpy as np

from tests.llm import hard
from vesper.llm import bm25, frames, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, asked, k, terms):
    bags = [Counter(words(t)) for _, t in docs]
    n, mean = len(docs), sum(b.total() for b in bags) / max(1, len(docs))
    df = Counter(w for b in bags for w in b)
    idf = lambda w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5))
    out = {}
    for q, t in asked:
        bag = Counter(words(t))
        worth = sorted(((idf(w) * c * 2.2 / (c + 1.2), w) for w, c in bag.items() if df[w]), reverse=True)
        if len(worth) > terms and worth[terms - 1][0] == worth[terms][0]:
            continue  # which of equal words is taken goes by their hashes
        hits = []
        for (d, _), b in zip(docs, bags, strict=True):
            s = sum(idf(w) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean)) for _, w in worth[:terms] if w in b)
            if s:
                hits.append((-round(s, 9), math.inf if d is None else d))
        out[q] = sorted(hits)[:k]
    return out


def check(docs, asked, k, terms, least=1):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, [tuple(r) for r in asked.select("doc_id", "text").distinct().collect() if r[0] is not None], k, terms)
    assert len(want) >= least
    got = {}
    for r in bm25.search(docs, asked, k, terms).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, math.inf if r.doc_id is None else r.doc_id))
    for q, hits in want.items():
        assert len(got.get(q, [])) == len(hits)
        assert np.allclose([s for s, _ in got.get(q, [])], [s for s, _ in hits], atol=1e-6)
        assert [d for _, d in got.get(q, [])] == [d for _, d in hits]


def test_as_brute_force(spark):
    docs = hard.sample(spark)
    check(docs, docs.where("doc_id % 7 = 0"), 10, 400, 20)
    check(docs, docs.where("doc_id % 50 = 0"), 5, 10_000, 3)


def test_hard_rows(spark):
    docs = hard.documents(spark)
    check(docs, docs, 4, 10_000, 8)
    assert bm25.search(hard.empty(spark), docs).collect() == [] and bm25.search(docs, hard.empty(spark)).collect() == []


def test_a_word_of_one_document_finds_it(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the zyzzyva sat"), (3, "qwxyz vbnmk"), (4, "the cat")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "Zyzzyva"), (3, "qwxyz vbnmk"), (11, "nowhere")], "doc_id long, text string")
    assert sorted((r.query_id, r.rank, r.doc_id) for r in bm25.search(docs, asked).collect()) == [(3, 1, 3), (10, 1, 2)]


def test_pruning_gives_the_best_of_all():
    rnd, rng = random.Random(1), np.random.default_rng(1)
    for _ in range(60):
        n, k = 3000, rnd.choice([1, 3, 10])
        ids = rng.permutation(n)
        lists = []
        for _ in range(rnd.randint(1, 6)):
            docs = np.flatnonzero(rng.random(n) < rnd.choice([0.001, 0.02, 0.4]))
            lists.append((docs, np.round(rng.random(docs.size) * rnd.choice([0.5, 4]), rnd.choice([1, 3]))))
        total = np.zeros(n)
        for d, s in lists:
            total[d] += s
        hit = np.unique(np.concatenate([d for d, _ in lists])) if lists else []
        best = sorted(((-round(float(total[d]), 6), int(ids[d])) for d in hit))[:k]
        assert [(-round(s, 6), int(ids[d])) for s, d in bm25.wand(lists, k, ids)] == best


def test_blocks_of_queries_agree(spark, monkeypatch):
    docs = hard.sample(spark)
    asked = docs.where("doc_id % 20 = 0")
    whole = sorted(map(tuple, bm25.search(docs, asked).collect()))
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 4)
    assert sorted(map(tuple, bm25.search(docs, asked).collect())) == whole


def test_registered_query_takes_whole_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    assert sum(len(set(words(t))) > 64 for _, t in asked) > 2
    want = {(q, i): (d, -s) for q, hits in brute(rows, asked, 10, 10**9).items() for i, (s, d) in enumerate(hits, 1)}
    for shard in (bm25.SHARD, 500):
        monkeypatch.setattr(bm25, "SHARD", shard)
        got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in queries.op5_topk_search(spark, "/root/testdata/sf0.001").collect()}
        assert got.keys() == want.keys()
        assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-6 for x in want)


def test_sums_as_wand():
    rng = np.random.default_rng(3)
    for k in (1, 5, 40):
        ids = rng.permutation(400)
        lists = [(d, np.round(rng.random(d.size), 1) + 0.1) for d in (np.flatnonzero(rng.random(400) < 0.05) for _ in range(50)) if d.size]
        assert bm25.sums(lists, k, ids) == bm25.wand(lists, k, ids)


def test_long_queries_are_pruned_and_exact(monkeypatch):
    rng = np.random.default_rng(11)
    n, many = 2000, 120
    ids = rng.permutation(n)
    lists = []
    for i in range(many):
        docs = np.flatnonzero(rng.random(n) < (0.3 if i < 40 else 0.01))
        lists.append((docs, np.round(rng.random(docs.size) * (1 if i < 40 else 6), 1) + 0.1))
    for few in (lists[40:45], lists[:45], lists):
        for copies in (0, 8):  # documents that score alike
            own = [(np.concatenate([d, np.arange(n, n + copies)]), np.concatenate([s, np.full(copies, s.max())])) for d, s in few]
            at = np.concatenate([ids, np.arange(n, n + copies)[::-1]])
            total = np.zeros(at.size)
            for d, s in own:
                total[d] += s
            for k in (1, 5, 12):
                best = sorted((-round(float(total[d]), 9), int(at[d])) for d in np.flatnonzero(total))[:k]
                for least in (0.0, -best[-1][0], -best[-1][0] * 0.9):
                    scored = []
                    exact = bm25.Shard.exact
                    monkeypatch.setattr(bm25.Shard, "exact", lambda self, docs, own, exact=exact, scored=scored: scored.append(docs.size) or exact(self, docs, own))
                    got = bm25.sums(own, k, at, least)
                    monkeypatch.setattr(bm25.Shard, "exact", exact)
                    assert [(-s, int(at[d])) for s, d in got] == best
                    assert sum(scored) < n / 4


def test_hits_do_not_grow_with_the_tasks(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(rnd.randrange(5, 90)))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked, kept, keep = docs.where("doc_id % 100 = 0"), {}, frames.keep
    monkeypatch.setattr(frames, "keep", lambda df, what: kept.setdefault(what, keep(df, what)))
    few = bm25.search(docs.coalesce(1), asked).orderBy("query_id", "rank").collect()
    kept.clear()
    many = bm25.search(docs.repartition(60), asked).orderBy("query_id", "rank").collect()
    assert many == few and len(few) > 250
    assert kept["hits"].count() < 30 * 10 * 3 * bm25.SAMPLE  # 60 tasks could give ten each


def test_queries_searched_together_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    n, many = 700, 150
    lists = [np.flatnonzero(rng.random(n) < (0.5 if i < 20 else 0.1 if i < 60 else 0.01)) for i in range(many)]
    term = np.repeat(np.arange(many), [x.size for x in lists])
    doc, score = np.concatenate(lists), np.round(rng.random(term.size) * 3, 2) + 0.01
    order = np.lexsort((term, doc))
    ids = rng.permutation(n)
    asked = [np.sort(rng.choice(many, size, replace=False)) for size in rng.integers(0, 90, 40)]
    for k in (1, 7):
        best = [bm25.wand([(doc[term == t], score[term == t]) for t in own], k, ids) for own in asked]
        for together, cells in ((256, 1 << 23), (3, 1 << 23), (16, 5 * n), (16, 0)):  # few and no long lists, too
            monkeypatch.setattr(bm25, "TOGETHER", together)
            monkeypatch.setattr(bm25, "CELLS", cells)
            shard = bm25.Shard(term[order], doc[order], score[order], ids, many)
            for part in (0.0, 0.8, 1.0):
                assert list(shard.searches(asked, k, [hits[-1][0] * part if len(hits) == k else 0.0 for hits in best])) == best


def test_first_search_has_tasks_in_proportion(spark):
    docs = spark.range(400).selectExpr("id as at", "'a b' as text")
    assert bm25.first_tasks(docs.repartition(20 * bm25.SAMPLE)) == 20
    assert bm25.first_tasks(docs.repartition(2)) == bm25.SAMPLE_TASKS
