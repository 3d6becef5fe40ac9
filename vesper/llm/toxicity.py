"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Words are read with A-Z lower-cased, look-alike signs turned into letters and punctuation at either end left out. Lexicons are learned
from one part of the sample: words, and stems (the first four or five bytes), that toxic documents hold far more
often than others, in a strong and a weak tier. The features of FEATURES are counted with them. Another part grows
trees on the logistic loss (histograms of quantile bins, depth DEPTH), the last calibrates their sums by pooling
adjacent violators. The sample has at most PER_CLASS rows of each label and MAX_BYTES of text; rows weigh what they
stand for, so scores are shares among labelled rows.

Scoring is a narrow scan over every whole text with a model of some hundred hashes and TREES small trees; sums come
from prefix sums over the batch. Nothing grows with the input.

Defined results: a null, empty or wordless text has the features' zeros and the score that trees give these;
without labelled rows of both classes every score is the prior; repeated rows and null doc_ids get rows of their own;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, labelled, text

#: Bounds of the sample that the model is fitted on.
PER_CLASS, MAX_BYTES = 2500, 24 << 20
TREES, DEPTH, RATE, BINS, LEAST_WEIGHT = 60, 3, 0.2, 32, 2.0
#: score >= CUT is predicted 1.
CUT = 0.7
FEATURES = ("words", "strong words", "strong word hits", "weak words", "strong stems", "strong stem hits", "hits near you", "capitals", "shouted words", "exclamations", "questions", "punctuation", "obfuscated words")
# Second-person pronouns of the languages that are met, and how near, in words, a hit counts.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "tus", "usted", "ustedes", "vosotros")
NEAR = 5
# Signs that stand for letters.
LOOKALIKES = dict(zip(b"013457@$", b"oieastas", strict=True))

_letters = np.zeros(256, dtype=bool)
_letters[65:91] = _letters[97:123] = True
_letters[128:] = True
_digits = np.zeros(256, dtype=bool)
_digits[48:58] = True
_signs = ~_letters & ~_digits & ~text.SPACES
_plain = text.LOWER.copy()
for _a, _b in LOOKALIKES.items():
    _plain[_a] = _b
_values = np.where(_letters[_plain], text.BYTE[_plain], np.uint64(0))
_capital = np.zeros(256, dtype=bool)
_capital[65:91] = True
_ascii_letter = _letters.copy()
_ascii_letter[128:] = False


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.size + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


@dataclass
class Words:
    """Of a batch's words: spans, hashes of the plain word and of its stems, and the first of each text."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    whole: np.ndarray
    stems: tuple[np.ndarray, np.ndarray]


def read(data: np.ndarray, offs: np.ndarray) -> Words:
    starts, ends, first = text.word_spans(data, offs)
    sums = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(_values[data] * text.powers(text.BASE, data.size), out=sums[1:])
    back = text.powers(text.INVERSE, data.size + 1)
    low = starts.copy()
    for _ in range(3):  # signs before a word; those after it add nothing
        low += (low < ends - 1) & ~_letters[_plain[data[np.minimum(low, data.size - 1)]]] if data.size else 0

    def upto(end):
        return text.mix((sums[end] - sums[low]) * back[low])

    return Words(starts, ends, first, upto(ends), (upto(np.minimum(low + 4, ends)), upto(np.minimum(low + 5, ends))))


def known(words) -> np.ndarray:
    data, offs = text.of_column(pa.array(list(words), pa.string()))
    return np.unique(read(data, offs).whole)


def within(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Which hashes the sorted lexicon has."""
    if not lexicon.size:
        return np.zeros(hashes.size, dtype=bool)
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(lexicon >> np.uint64(48)).astype(np.int64)] = True
    out = maybe[(hashes >> np.uint64(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(lexicon, hashes[at]), lexicon.size - 1)
    out[at] = lexicon[place] == hashes[at]
    return out


YOU = known(SECOND_PERSON)


@dataclass
class Lexicons:
    strong: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weak: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def learn_lexicons(texts: list[str], labels: np.ndarray) -> Lexicons:
    parts: dict[str, list[list[np.ndarray]]] = {"whole": [[], []], "stems": [[], []]}
    for t, y in zip(texts, labels, strict=True):
        data, offs = text.of_column(pa.array([t], pa.string()))
        words = read(data, offs)
        parts["whole"][y].append(np.unique(words.whole))
        parts["stems"][y].append(np.unique(np.concatenate(words.stems)))
    n = np.bincount(labels, minlength=2)

    def tier(kind, least, share, odds):
        many = [np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts[kind]]
        toxic, c1 = np.unique(many[1], return_counts=True)
        plain, c0 = np.unique(many[0], return_counts=True)
        other = np.zeros(toxic.size)
        if plain.size and toxic.size:
            at = np.minimum(np.searchsorted(plain, toxic), plain.size - 1)
            other = np.where(plain[at] == toxic, c0[at], 0)
        gain = np.log((c1 + 0.5) / (n[1] + 1)) - np.log((other + 0.5) / (n[0] + 1))
        return toxic[(c1 >= max(least, share * n[1])) & (gain >= odds)]

    strong = tier("whole", 3, 0.015, 3.0)
    return Lexicons(strong, np.setdiff1d(tier("whole", 2, 0.004, 1.5), strong), tier("stems", 3, 0.015, 3.0))


def features(data: np.ndarray, offs: np.ndarray, lexicons: Lexicons) -> np.ndarray:
    words = read(data, offs)
    starts, ends, first = words.starts, words.ends, words.first

    def per_text(flags):
        sums = _sums(flags)
        return (sums[first[1:]] - sums[first[:-1]]).astype(np.float64)

    def per_bytes(flags):
        sums = _sums(flags[data])
        return (sums[offs[1:]] - sums[offs[:-1]]).astype(np.float64)

    def in_word(flags):
        sums = _sums(flags[data])
        return sums[ends] - sums[starts]

    n = np.maximum(1, np.diff(first)).astype(np.float64)
    strong, weak = within(words.whole, lexicons.strong), within(words.whole, lexicons.weak)
    stem = within(words.stems[0], lexicons.stems) | within(words.stems[1], lexicons.stems)
    you = _sums(within(words.whole, YOU))
    at = np.arange(starts.size)
    low, high = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    near = (strong | stem) & (you[np.minimum(at + NEAR + 1, high)] > you[np.maximum(at - NEAR, low)])
    capitals, letters, signs, digits = in_word(_capital), in_word(_ascii_letter), in_word(_signs), in_word(_digits)
    edge = np.zeros(starts.size, dtype=np.int64)
    if starts.size:
        edge = _signs[data[starts]].astype(np.int64) + _signs[data[ends - 1]]
    marks = np.zeros((2, 256), dtype=bool)
    marks[0, 33] = marks[1, 63] = True
    hits, stems = per_text(strong), per_text(stem)
    return np.stack([
        np.log1p(np.diff(first)), hits / n, hits, per_text(weak) / n, stems / n, stems, per_text(near) / np.maximum(1, np.maximum(hits, stems)),
        per_bytes(_capital) / np.maximum(1, per_bytes(_ascii_letter)), per_text((letters >= 3) & (capitals == letters)) / n,
        per_bytes(marks[0]) / n, per_bytes(marks[1]) / n, per_bytes(_signs) / np.maximum(1, offs[1:] - offs[:-1]),
        per_text((letters >= 2) & ((signs > edge) | (digits > 0))) / n,
    ], axis=1)


@dataclass
class Tree:
    """A complete tree by levels: at node i the rows with feature <= cut go to 2 i + 1, the others to 2 i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def apply(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (rows[np.arange(len(rows)), self.feature[node]] > self.cut[node])
        return self.value[node - (2**DEPTH - 1)]


def grow(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, start: float) -> list[Tree]:
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total, trees = np.full(len(rows), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, curve = weights * (labels - p), weights * p * (1 - p)
        inner = 2**DEPTH - 1
        tree = Tree(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**DEPTH))
        node = np.zeros(len(rows), dtype=np.int64)
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            best = 1e-9
            for f, c in enumerate(cuts):
                if mine.size and c.size:
                    g = np.cumsum(np.bincount(binned[mine, f], weights=slope[mine], minlength=c.size + 1))
                    h = np.cumsum(np.bincount(binned[mine, f], weights=curve[mine], minlength=c.size + 1))
                    w = np.cumsum(np.bincount(binned[mine, f], weights=weights[mine], minlength=c.size + 1))
                    gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                    gain[(w[:-1] < LEAST_WEIGHT) | (w[-1] - w[:-1] < LEAST_WEIGHT)] = 0
                    if gain.max() > best:
                        best, tree.feature[i], tree.cut[i] = gain.max(), f, c[int(gain.argmax())]
            node[mine] = 2 * i + 1 + (rows[mine, tree.feature[i]] > tree.cut[i])
        leaf = node - inner
        g, h = (np.bincount(leaf, weights=x, minlength=2**DEPTH) for x in (slope, curve))
        tree.value = RATE * g / (h + 1)
        total = total + tree.value[leaf]
        trees.append(tree)
    return trees


def isotonic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints of the best non-decreasing fit, by pooling adjacent violators; between them it is read linearly."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least x, greatest x
    for i in order:
        blocks.append([float(y[i]), float(weights[i]), float(x[i]), float(x[i])])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, hi = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, hi
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


@dataclass
class Model:
    lexicons: Lexicons
    trees: list[Tree]
    start: float
    curve: tuple[np.ndarray, np.ndarray] | None

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.start + sum(t.apply(rows) for t in self.trees) if self.trees else np.full(len(rows), self.start)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        raw = self.raw(rows)
        plain = 1 / (1 + np.exp(-raw))
        # A hundredth of the trees' own score keeps their order where the fit is level.
        return 0.99 * np.interp(raw, *self.curve) + 0.01 * plain if self.curve else plain


def fit(sample: labelled.Sample) -> Model:
    prior, y = sample.prior, sample.labels
    start = float(np.log(prior / (1 - prior)))
    if np.bincount(y, minlength=2).min() < 1:
        return Model(Lexicons(), [], start, None)
    # The n-th row of each class goes to a part by n, so that parts have the classes' shares.
    nth = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) - 1
    part = np.where(nth % 20 < 9, 0, np.where(nth % 20 < 16, 1, 2))
    if min(np.bincount(y[part == k], minlength=2).min() for k in (0, 1, 2)) < 1:
        part = nth % 3 if np.bincount(y, minlength=2).min() >= 3 else np.full(y.size, -1)
    chosen = [np.flatnonzero((part == k) | (part == -1)) for k in (0, 1, 2)]
    lexicons = learn_lexicons([sample.texts[i] for i in chosen[0]], y[chosen[0]])
    data, offs = text.of_column(pa.array(sample.texts, pa.string()))
    rows = np.concatenate([features(d, o, lexicons) for _, _, d, o in text.slices(data, offs)])
    trees = grow(rows[chosen[1]], y[chosen[1]], sample.weights[chosen[1]], start)
    model = Model(lexicons, trees, start, None)
    at = chosen[2]
    model.curve = isotonic(model.raw(rows[at]), y[at], sample.weights[at])
    return model


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1) -> Model:
    return fit(labelled.draw(docs, labels, "toxic", mod, held, PER_CLASS, MAX_BYTES))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text.of_column(batch.column("text"))
        found = [model.scores(features(d, o, model.lexicons)) for _, _, d, o in text.slices(data, offs)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(np.concatenate(found), 0, 1))], ["doc_id", "score"])

    return frames.scan(frames.doc_columns(docs, "doc_id", "text"), kernel, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; the model is fitted on labelled rows outside the held-out fold."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (labelled.remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
