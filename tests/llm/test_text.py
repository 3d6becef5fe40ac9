"""Hashes of words, lines and units: equal for equal bytes, apart for strings that polynomials modulo 2**64 confuse."""

import numpy as np
import pyarrow as pa

from vesper.llm import bm25, jaccard, line_dedup, quality_rules, text


def alternating(n, one, two):
    """The two Thue-Morse sequences of n signs."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [one if b else two for b in bits], [two if b else one for b in bits]


def of(*texts):
    return text.of_column(pa.array(texts, pa.string()))


def test_equal_spans_have_equal_hashes_and_others_do_not():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    starts, size = rng.integers(0, 2000, 5000), rng.integers(0, 300, 5000)
    seen = {}
    for h, a, n in zip(text.hash_spans(data, starts, starts + size), starts, size, strict=True):
        assert seen.setdefault(data[a : a + n].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_alternating_words_stay_apart():
    for n in (1024, 4096):
        a, b = ("".join(x) for x in alternating(n, "a", "b"))
        assert len(np.unique(bm25.term_hashes(*of(a, b))[0])) == 2
        assert jaccard.sets(*of(a, b), 4)[0] != jaccard.sets(*of(a, b), 4)[1]
        judged = quality_rules.judge(*of(f"{a}\n{b}\n{a}"))
        assert judged["n_dup_lines"].tolist() == [1]


def test_long_alternating_units_stay_apart():
    a, b = (" ".join(x) for x in alternating(1024, "left", "right"))
    _, _, one, two, _, _ = line_dedup.units(*of(a + "\n" + b + "\n" + a), 4)
    assert one[0] != one[1] and two[0] != two[1] and one[0] == one[2] and two[0] == two[2]
