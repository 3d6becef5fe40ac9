"""Ids against the library and against merging by a scan for the least rank; decoding as an exact round trip."""

import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.llm import hard
from vesper.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def scanned(cut, ranks):
    parts = [cut[i : i + 1] for i in range(len(cut))]
    while True:
        least = min((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks) if any(a + b in ranks for a, b in zip(parts, parts[1:], strict=False)) else None
        if least is None:
            return [ranks[p] for p in parts]
        i = least[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_is_the_scan_even_if_later_pairs_have_lesser_ranks():
    rnd = random.Random(1)
    for _ in range(300):
        tokens = {bytes([b]) for b in b"abc"}
        for _ in range(rnd.randrange(2, 14)):  # tokens in no order of making, so that a join can bring a pair of lesser rank
            tokens.add(bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(2, 6))))
        order = sorted(tokens)
        rnd.shuffle(order)
        ranks, queue = {t: i * 7 for i, t in enumerate(order)}, bpe.RankQueue(7 * len(order))
        for n in (1, 2, 3, 9, 40):
            cut = bytes(rnd.choice(b"aabc") for _ in range(n))
            assert bpe.merge(cut, ranks, queue) == scanned(cut, ranks), (cut, ranks)
            assert not queue.buckets and not queue.top and not any(queue.words)


def test_queue_takes_ranks_in_order():
    rnd, queue = random.Random(2), bpe.RankQueue(70_000)
    some = rnd.sample(range(70_000), 500)
    for r in some:
        queue.add(r, [r])
    assert [queue.take() for _ in range(501)] == [(r, [r]) for r in sorted(some)] + [(-1, [])]


def test_codec_is_the_library(library):
    codec, rnd = bpe.codec(PATH, PATTERN), random.Random(3)
    parts = ["a", "b", "aa", " ", "  ", "\n", "\t\r\n", "é", "日本", "՘", "\U00010940", "꟎", "\U0001f600", "1", "Ⅷ", "'s", "'LL", " ", "\x85", "\x1c", "<|endoftext|>", "can't", "\x00", "_", "́"]
    for _ in range(2000):
        said = "".join(rnd.choice([*parts, chr(rnd.randrange(0xD7FF))]) for _ in range(rnd.randrange(30)))
        assert codec.encode(said) == array("I", library.encode_ordinary(said)).tobytes(), repr(said)
        assert codec.decode(codec.encode(said)) == said.encode()
    with pytest.raises(ValueError, match="50256"):
        codec.decode(array("I", [50256]).tobytes())


def test_every_sign_is_cut_as_by_the_library(library):
    codec = bpe.codec(PATH, PATTERN)
    signs = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xAC40), *range(0xF900, 0x12F00, 3), *range(0x1D000, 0x1F000, 7), *range(0x2F800, 0x33500, 11)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(signs), 500):
        said = "".join(f"a{s}1{s}{s} " for s in signs[at : at + 500])
        assert codec.encode(said) == array("I", library.encode_ordinary(said)).tobytes(), hex(ord(signs[at]))


@pytest.mark.parametrize("cut", ["a" * 60_000, "ab" * 30_000, " " * 50_000, "日本語" * 8_000, "=" * 40_001, "qwertyuiopasdfghjkl" * 3_000])
def test_very_long_cuts(library, cut):
    assert bpe.codec(PATH, PATTERN).encode(cut) == array("I", library.encode_ordinary(cut)).tobytes()


def test_texts_of_many_cuts_and_few_remembered_ones(library, monkeypatch):
    said = hard.LONG[:100_000]
    monkeypatch.setattr(bpe, "CUTS", 1000)
    monkeypatch.setattr(bpe, "CACHE", 100)
    assert bpe.Codec(PATH, PATTERN).encode(said) == array("I", library.encode_ordinary(said)).tobytes()


def test_hard_documents_and_lists(spark, library):
    docs = hard.documents(spark).withColumnRenamed("count", "ids").withColumn("n_tokens", F.lit("x"))
    encoded = bpe.encode(docs, PATH, PATTERN)
    ids = lambda t: array("I", library.encode_ordinary(t or ""))
    want = [(i, t) for i, t in [*hard.TEXTS, hard.TEXTS[0]]]
    got = bpe.decode(encoded, PATH, PATTERN).collect()
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got), key=str) == sorted(((i, len(ids(t)), ids(t).tobytes(), (t or "").encode()) for i, t in want), key=str)
    assert sorted((r.doc_id, r.ids) for r in bpe.lists(encoded).where("doc_id < 10").collect()) == sorted((i, list(ids(t))) for i, t in want if i is not None and i < 10)
    assert bpe.encode(hard.empty(spark), PATH, PATTERN).count() == 0
    assert bpe.decode(spark.createDataFrame([Row(doc_id=1, ids=None)], "doc_id long, ids binary"), PATH, PATTERN).first().decoded == b""


def test_runs_hold_about_so_much(monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 10)
    assert list(bpe._runs(bpe.np.array([4, 4, 4, 30, 0, 0, 9]))) == [(0, 2), (2, 3), (3, 4), (4, 7)]


def test_query_is_the_library(spark, library):
    import hashlib

    got = {r.doc_id: r for r in queries.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = hard.sample(spark).select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = array("I", library.encode_ordinary(d.text or "")), got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
