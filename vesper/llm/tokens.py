"""Exact ids of a byte-level tokenizers file, at the speed of a plain merge loop.

Texts of plain letters and signs (below U+0250) are encoded by tiktoken over the file's own merges and cuts, several
times as fast as the tokenizer; texts with others, with control characters or white space beyond ASCII, or with what may be a special
token, go to the tokenizer itself, and so does everything if the file's merges or pre-tokenizer aren't of that kind.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: What the two libraries might not cut alike.
BEYOND = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]|<\\|")
# Fixed value: how the byte-level pre-tokenizer cuts.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shown_bytes() -> dict[str, int]:
    """The signs that byte-level vocabularies write bytes as: printable ones as themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merge_encoding(path: str, marks: dict[str, int] | None = None):
    """A tiktoken encoding of the file's merges, or None if it isn't a plain byte-level file with ids in order of merging.

    ``marks`` are its special tokens with their ids.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    cutter, model = said.get("pre_tokenizer") or {}, said["model"]
    if said.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or model.get("type", "BPE") != "BPE":
        return None
    signs, vocabulary = shown_bytes(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [vocabulary.get(a + b) for a, b in merges]
    if None in ids or ids != sorted(ids) or any(s not in vocabulary or vocabulary[s] >= ids[0] for s in signs):
        return None
    ranks = {bytes([b]): vocabulary[s] for s, b in signs.items()} | {bytes(signs[c] for c in a + b): i for (a, b), i in zip(merges, ids, strict=True)}
    return tiktoken.Encoding("file", pat_str=CUTS, mergeable_ranks=ranks, special_tokens=marks or {})


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = merge_encoding(path)

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        plain = self.fast is not None and not BEYOND.search(text)
        return array("I", self.fast.encode_ordinary(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class MarkedEncoder:
    """Ids and character offsets of texts in which some strings, the marks, are special tokens."""

    def __init__(self, path: str, marks: tuple[str, ...]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in marks])
        ids = {m: self.tokenizer.token_to_id(m) for m in marks}
        self.marks, self.fast = set(marks), merge_encoding(path, ids)
        if self.fast is not None:
            self.sizes = np.zeros(max(self.fast.max_token_value, *ids.values()) + 1, dtype=np.int64)
            for said in self.fast.token_byte_values():
                self.sizes[self.fast.encode_single_token(said)] = len(said)
            for mark, i in ids.items():
                self.sizes[i] = len(mark.encode())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts and ends; a token that has only some of a character's bytes covers the character."""
        if self.fast is None or BEYOND.search(text):
            said = self.tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(said.offsets, dtype=np.int32).reshape(-1, 2)
            return np.array(said.ids, dtype=np.int32), offsets[:, 0], offsets[:, 1]
        ids = self.fast.encode_to_numpy(text, allowed_special=self.marks, disallowed_special=()).astype(np.int32)
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        if not text.isascii():
            begun = np.zeros(int(ends[-1]) + 1, dtype=np.int64)  # characters that begin before each byte
            np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80, out=begun[1:])
            starts, ends = begun[starts + 1] - 1, begun[ends]
        return ids, starts.astype(np.int32), ends.astype(np.int32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_marked: dict[tuple, MarkedEncoder] = {}


def marked_encoder(path: str, marks: tuple[str, ...]) -> MarkedEncoder:
    """One for each file, marks and Python worker."""
    if (path, marks) not in _marked:
        _marked[path, marks] = MarkedEncoder(path, marks)
    return _marked[path, marks]
