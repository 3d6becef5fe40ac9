"""Line-first cleaning: rules drop lines, and documents that lose too much text are rejected.

Each line of a text is held against three families of rules:

* punctuation: no word of it ends in ``. ! ?``; or over 3 in 10 words end in ``!!``; or symbols are
  over a tenth of its characters;
* navigation: at least two words that are a lone separator, and these are a fifth of its words or more;
* boilerplate: it holds one of BOILERPLATE (A-Z lower-cased).

Lines without a word are no text and never fail. What is left is the cleaned text; a document is
kept if it passes the base rules and at most half of its characters went with failed lines.

Everything is counted on whole texts, batch by batch, without a shuffle, so neither skew nor copies
matter. Defined results: a null or empty text, or one of spaces, has zeros, fails the base rules
(under 20 words) and is not kept; a null doc_id stays null; repeated rows each give a row; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames, text

# What boilerplate lines say.
BOILERPLATE = (
    b"all rights reserved", b"terms of use", b"terms of service", b"privacy policy", b"cookie policy", b"use cookies",
    b"licensed under", b"is licensed under", b"released under the", b"lorem ipsum", b"click here", b"sign up",
    b"subscribe to", b"enable javascript", b"skip to content", b"back to top", b"read more", b"share this",
)
# The base rules.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
BASE_SYMBOLS = b"#*$%&|<>"
# The line rules.
LINE_SYMBOLS = b"#*$%&|<>~^=_{}\\"
SEPARATORS = b"|></-*+"
MAX_LOST_PERCENT = 50

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, chars_removed long, clean_text string"


def _lut(marks: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(marks)] = True
    return found


BASE_LUT, LINE_LUT, SEPARATOR_LUT, STOPS = _lut(BASE_SYMBOLS), _lut(LINE_SYMBOLS), _lut(SEPARATORS), _lut(b".!?")
CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(flags.size + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def twice(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does its owner have it more than once, and is this a later one."""
    own = text.mix(keys ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    many, later = np.zeros(keys.size, bool), np.zeros(keys.size, bool)
    many[order[1:]] |= same
    many[order[:-1]] |= same
    later[order[1:]] = same
    return many, later


def judge(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and verdicts of texts, and for each line whether it failed."""
    n = offs.size - 1
    starts, ends, first = text.word_spans(data, offs)
    hashes = text.hash_spans(data, starts, ends)
    points = _sums(~CONTINUES[data])
    chars = points[ends] - points[starts]
    word_sums = _sums(chars)
    n_words, word_chars = np.diff(first), word_sums[first[1:]] - word_sums[first[:-1]]
    symbols = _sums(BASE_LUT[data])

    keys, at = text.windows(hashes, first, REPEAT_WINDOW)
    many, _ = twice(keys, np.searchsorted(first, at, side="right") - 1)
    cover = np.zeros(starts.size + REPEAT_WINDOW + 1, dtype=np.int64)
    np.add.at(cover, at[many], 1)
    np.add.at(cover, at[many] + REPEAT_WINDOW, -1)
    repeated = _sums(np.cumsum(cover)[: starts.size] > 0)

    lo, hi, lines = text.line_spans(data, offs)
    w0, w1 = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    words = w1 - w0
    owner = np.repeat(np.arange(n), np.diff(lines))
    full = words > 0
    _, later = twice(text.hash_spans(data, lo[full], hi[full]), owner[full])
    dup_lines = np.bincount(owner[full][later], minlength=n)

    tail = data[ends - 1] if ends.size else np.zeros(0, np.uint8)
    stops = _sums(STOPS[tail])
    shout = (tail == 33) & (ends - starts >= 2)
    shout[shout] = data[ends[shout] - 2] == 33
    shouts = _sums(shout)
    alone = _sums((ends - starts == 1) & SEPARATOR_LUT[tail])
    line_chars = word_sums[w1] - word_sums[w0]
    marks = _sums(LINE_LUT[data])
    lone = alone[w1] - alone[w0]
    failed = (stops[w1] == stops[w0]) | (10 * (shouts[w1] - shouts[w0]) > 3 * words) | (10 * (marks[hi] - marks[lo]) > line_chars)
    failed |= (lone >= 2) & (5 * lone >= words)
    lowered = text.LOWER[data].tobytes()
    for phrase in BOILERPLATE:
        p = lowered.find(phrase)
        while p >= 0:
            line = int(np.searchsorted(lo, p, side="right")) - 1
            if p + len(phrase) <= hi[line]:
                failed[line] = True
            p = lowered.find(phrase, p + 1)
    failed &= full
    lost = np.bincount(owner[failed], weights=line_chars[failed], minlength=n).astype(np.int64)
    repeats = repeated[first[1:]] - repeated[first[:-1]]
    base_failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]], "n_dup_lines": dup_lines, "n_repeat_words": repeats,
        "base_failed": base_failed, "kept": ~base_failed & (100 * lost <= MAX_LOST_PERCENT * word_chars), "n_lines": np.diff(lines),
        "n_lines_removed": np.bincount(owner[failed], minlength=n), "chars_removed": lost,
        "_failed": failed, "_lo": lo, "_hi": hi, "_lines": lines,
    }


def _cleaned(data: np.ndarray, offs: np.ndarray, found: dict[str, np.ndarray]) -> list[str]:
    raw, out = data.tobytes(), []
    for i, dropped in enumerate(found["n_lines_removed"]):
        if not dropped:
            out.append(raw[offs[i] : offs[i + 1]].decode())
            continue
        lines = range(found["_lines"][i], found["_lines"][i + 1])
        out.append(b"\n".join(raw[found["_lo"][k] : found["_hi"][k]] for k in lines if not found["_failed"][k]).decode())
    return out


def clean(docs: DataFrame) -> DataFrame:
    """A row per document: the base counts, the verdicts and the cleaned text (see SCHEMA)."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text.of_column(batch.column("text"))
        parts: dict[str, list] = {}
        for _, _, d, o in text.slices(data, offs):
            found = judge(d, o)
            for k, v in found.items():
                if not k.startswith("_"):
                    parts.setdefault(k, []).append(pa.array(v if v.dtype == bool else v.astype(np.int64)))
            parts.setdefault("clean_text", []).append(pa.array(_cleaned(d, o, found), pa.string()))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.concat_arrays(v) for k, v in parts.items()})

    return frames.scan(frames.doc_columns(docs, "doc_id", "text"), kernel, SCHEMA)
