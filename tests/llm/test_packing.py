import itertools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import hard
from vesper.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def optimum(sizes, capacity):
    """Fewest bins, by trying all."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def check_runs(runs, counts, capacity):
    left = np.array(counts)
    for n, lengths in runs:
        assert n > 0 and sum(lengths) <= capacity
        for x in lengths:
            left[x] -= n
    assert not left.any()


def test_search_finds_the_optimum_on_small_cases():
    rnd = random.Random(1)
    for _ in range(150):
        sizes = sorted((rnd.randint(2, 30) for _ in range(rnd.randint(1, 11))), reverse=True)
        counts = np.bincount(sizes, minlength=31)
        runs = packing.bin_completion(counts, 30)
        check_runs(runs, counts, 30)
        assert sum(n for n, _ in runs) <= optimum(sizes, 30)


def test_search_is_close_to_the_bound():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(1024, rng.lognormal(5.5, 1.0, 20_000).astype(int) + 1), minlength=1025)
    runs = packing.bin_completion(counts, 1024)
    check_runs(runs, counts, 1024)
    assert sum(n for n, _ in runs) <= packing.lower_bound(counts, 1024) * 1.001 + 1


def test_ids_are_the_tokenizers(spark):
    own, plain = tokens.encoder(PATH), Tokenizer.from_file(PATH)
    odd = ["", " ", "  ", "a  b", "a\n b", "a \nb", "\n\n x", "x ", " x", "it's we'll  go", "a b", "a\x1cb c", "<|endoftext|> x <|endoftext|>", "é é ñ", "\U0001f600 \U0001f600x 1234 5,6", "tab\tx\t\ty z", "a\r\n b \r\n"]
    odd += ["".join(random.Random(i).choice(" \n\ta'sZé1.!<　") for _ in range(30)) for i in range(400)]
    for t in [*odd, *[r.text for r in hard.sample(spark).collect()], hard.LONG]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_packed_documents(spark):
    for docs in (hard.documents(spark), hard.sample(spark)):
        plain = Tokenizer.from_file(PATH)
        rows = packing.pack(docs, PATH).collect()
        want = []
        for d, t in docs.select("doc_id", "text").collect():
            ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            head = len(ids) % 1024 or min(1024, len(ids))
            cuts = [0, *range(head, len(ids) + 1, 1024)]
            want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
        assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
        end = {}
        for s, o, n in sorted((r.sequence_id, r.offset, r.length) for r in rows):
            assert end.get(s, 0) == o
            end[s] = o + n
        assert max(end.values()) <= 1024
        counts = np.bincount([r.length for r in rows], minlength=1025)
        assert len(end) <= 1 + 1.01 * packing.lower_bound(counts, 1024)


def test_ids_and_empty_table(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), PATH, capacity=2, with_ids=True).collect()
    assert sorted((r.piece, len(r.ids)) for r in rows) == [(0, 2), (1, 2)]
    assert packing.pack(hard.empty(spark), PATH).collect() == []


def test_bins_of_more_than_four_pieces():
    rng = np.random.default_rng(4)
    for low, high, each in ((190, 215, 5), (150, 185, 6)):
        counts = np.bincount(rng.integers(low, high + 1, 20_000), minlength=1025)
        runs = packing.bin_completion(counts, 1024)
        check_runs(runs, counts, 1024)
        assert sum(n for n, _ in runs) == -(-20_000 // each) == packing.lower_bound(counts, 1024)


def test_search_finds_the_optimum_with_many_pieces_a_bin():
    rnd = random.Random(5)
    for _ in range(60):
        sizes = [rnd.randint(3, 8) for _ in range(rnd.randint(8, 13))]
        counts = np.bincount(sizes, minlength=31)
        runs = packing.bin_completion(counts, 30)
        check_runs(runs, counts, 30)
        assert packing.lower_bound(counts, 30) <= sum(n for n, _ in runs) == optimum(sizes, 30)


def test_fillings_are_all_undominated_ones():
    left = np.bincount([12, 7, 7, 5, 4, 4, 3], minlength=31)
    got = [f for f in packing.fillings(left, 12, 30) if f]
    assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
    pieces, all_ = [7, 7, 5, 4, 4, 3], set()
    for n in range(1, 7):
        all_ |= {f for f in itertools.combinations(pieces, n) if sum(f) <= 18}
    assert set(got) <= all_ and all(any(packing.dominated(f, g) for g in got) for f in all_)
