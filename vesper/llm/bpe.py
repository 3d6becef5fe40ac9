r"""Byte-level BPE by a file of ranks: texts to ids, as the tiktoken library gives them, and ids to bytes.

A text is cut by a pattern; each cut (pre-token) that isn't a token is merged by itself: of all neighbouring parts whose
joined bytes have a rank, those of least rank join first, the leftmost of equals first. Parts are a doubly linked list over
the cut's bytes. A pair waits in the bucket of its rank; bits say which buckets hold something, and bits above them which
words of bits do, so the next rank comes by a find-first-set at each level. A join makes the pairs beside it void without
looking for them: an entry whose place no longer has that rank is stale and is skipped. So a cut of n bytes takes n steps of
nearly constant work and some 20 bytes of memory a byte, where scanning for the least rank takes n * n.

Every text is whole, whatever its length, and each is encoded where it is read: no shuffle and no state between tasks. Cuts
that were met before come from a table of bounded size in each worker.

Null texts are empty: no ids. Rows keep their doc_id (null too) and number, repeated ones too; other columns are ignored,
whatever their names. An empty table gives an empty one. Ids that the file doesn't have are an error in ``decode``.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: Cuts remembered by a worker before the older half that wasn't met again goes, and the longest of these (in characters): some 220 MB.
CACHE, CACHE_CHARS = 1 << 20, 32
#: Characters of text whose ids leave a worker together; a longer text leaves alone.
BATCH_CHARS = 1 << 22
#: Cuts that are held at a time.
CUTS = 1 << 20
#: Bytes from which a cut's parts are held as numbers of four bytes.
LONG = 1 << 14
ENCODED, DECODED = "doc_id long, n_tokens long, ids binary", "doc_id long, n_tokens long, ids binary, decoded binary"


class RankQueue:
    """Places by rank: a bucket for each rank, a bit for each bucket that holds something, and a bit for each word of such bits."""

    #: Bits in a word.
    WORD = 256

    def __init__(self, ranks: int):
        self.words, self.top = [0] * -(-ranks // self.WORD), 0
        self.buckets: dict[int, list | array] = {}
        #: A rank's word, the word's bit, and its own bit.
        self.at = [(r >> 8, 1 << (r >> 8), 1 << (r & 255)) for r in range(ranks)]

    def add(self, rank: int, places: list | array) -> None:
        """A new bucket."""
        self.buckets[rank] = places
        word, above, bit = self.at[rank]
        self.words[word] |= bit
        self.top |= above

    def take(self) -> tuple[int, list | array]:
        """The least rank that has places, and its bucket, which is then empty; -1 if there is none."""
        top = self.top
        if not top:
            return -1, []
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        self.words[word] = rest = bits & (bits - 1)
        if not rest:
            self.top = top & (top - 1)
        rank = word << 8 | (bits ^ rest).bit_length() - 1
        return rank, self.buckets.pop(rank)


def _compact(places) -> array:
    return array("i", places)


def merge(cut: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of a cut: parts joined by least rank, leftmost first, until no two neighbours have one. The queue is left empty."""
    n = len(cut)
    box = list if n < LONG else _compact  # some 20 bytes for each byte of a long cut
    after, before, rank_at = box(range(1, n + 1)), box(range(-1, n - 1)), box([-1]) * n
    known, buckets, words, at, top = ranks.get, queue.buckets, queue.words, queue.at, 0
    # What RankQueue.add and .take do stands here in full: calls would take a third of the time of short cuts.
    for p in range(n - 1):
        if (new := known(cut[p : p + 2])) is not None:
            rank_at[p] = new
            if new in buckets:
                buckets[new].append(p)
            else:
                buckets[new] = box((p,))
                word, above, bit = at[new]
                words[word] |= bit
                top |= above
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        words[word] = rest = bits & (bits - 1)
        if not rest:
            top &= top - 1
        rank = word << 8 | (bits ^ rest).bit_length() - 1
        places = buckets.pop(rank)
        if len(places) > 1:
            places = _in_order(places)
        for i, p in enumerate(places):
            if rank_at[p] != rank:
                continue  # stale: a part of this pair has joined another
            q = after[p]
            after[p] = end = after[q]
            rank_at[q] = rank_at[p] = -1
            least = rank
            if end < n:
                before[end] = p
                if (new := known(cut[p : after[end]])) is not None:
                    rank_at[p] = least = new
                    if new in buckets:
                        buckets[new].append(p)
                    else:
                        buckets[new] = box((p,))
                        word, above, bit = at[new]
                        words[word] |= bit
                        top |= above
            if p:
                o = before[p]
                if (new := known(cut[o:end])) is None:
                    rank_at[o] = -1
                else:
                    rank_at[o] = new
                    if new in buckets:
                        buckets[new].append(o)
                    else:
                        buckets[new] = box((o,))
                        word, above, bit = at[new]
                        words[word] |= bit
                        top |= above
                    if new < least:
                        least = new
            if least < rank and i + 1 < len(places):  # pairs of a lesser rank go before the rest of this bucket
                buckets[rank] = places[i + 1 :]
                word, above, bit = at[rank]
                words[word] |= bit
                top |= above
                break
    ids, p = [], 0
    while p < n:
        ids.append(ranks[cut[p : after[p]]])
        p = after[p]
    return ids


def _in_order(places: list | array) -> list | array:
    if isinstance(places, list):
        places.sort()
        return places
    at = np.frombuffer(places, dtype=np.int32)
    return places if (at[1:] > at[:-1]).all() else array("i", np.sort(at).tobytes())


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token with its bytes in base 64 and its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} lacks some of the 256 single bytes")
    return ranks


#: Below U+0558 the two libraries have one idea of letters and numbers (a test holds them together).
BEYOND = re.compile("[\u0558-\U0010ffff]")


def as_tiktoken(pattern: str) -> str:
    r"""The pattern with each \p{...} as tiktoken's Unicode version has it, for regex's version 1 sets."""
    import regex
    import tiktoken

    signs = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    one_each = {bytes([b]): b for b in range(256)}

    def spelled(some: set[str]) -> str:
        """Code points as ranges."""
        points = np.array(sorted(map(ord, some)))
        cuts = np.flatnonzero(np.diff(points) > 1)
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.r_[0, cuts + 1]], points[np.r_[cuts, points.size - 1]], strict=True))

    for kind in set(re.findall(r"\\p\{\w+\}", pattern)):
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=one_each, special_tokens={}).encode_ordinary(signs)).decode())
        ours = set(regex.findall(kind, signs))
        said = kind
        if less := ours - theirs:
            said = f"[{said}--[{spelled(less)}]]"
        if more := theirs - ours:
            said = f"[{said}||[{spelled(more)}]]"
        pattern = pattern.replace(kind, said)
    return pattern


class Codec(dict):
    """Cut -> its ids as little-endian unsigned 32-bit bytes, for the cuts met so far; and whole texts by these."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        self.ranks, self.pattern = read_ranks(path), pattern
        self.older: dict[str, bytes] = {}
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.plain, self.exact = regex.compile(pattern, regex.V1), None
        self.bytes = {rank: token for token, rank in self.ranks.items()}

    def __missing__(self, cut: str) -> bytes:
        if (ids := self.older.get(cut)) is None:
            said = cut.encode()
            whole = self.ranks.get(said)
            ids = array("I", merge(said, self.ranks, self.queue) if whole is None else (whole,)).tobytes()
        if len(cut) <= CACHE_CHARS:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[cut] = ids
        return ids

    def encode(self, text: str) -> bytes:
        cutter = self.plain
        if BEYOND.search(text):
            import regex

            cutter = self.exact = self.exact or regex.compile(as_tiktoken(self.pattern), regex.V1)
        if len(text) <= CUTS:
            return b"".join(map(self.__getitem__, cutter.findall(text)))
        cuts, out = (m.group() for m in cutter.finditer(text)), []
        while some := b"".join(map(self.__getitem__, islice(cuts, CUTS))):
            out.append(some)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        except KeyError as error:
            raise ValueError(f"No token has the id {error.args[0]}") from None


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each file, pattern and Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, past the last) of runs of rows with about BATCH_CHARS between them."""
    ends, at = np.cumsum(sizes), 0
    while at < sizes.size:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, side="right")))
        yield at, end
        at = end


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row: ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for a, b in _runs(batch.column("size").to_numpy()):
                ids = [own.encode(t) for t in batch.column("text").slice(a, b - a).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
                ids = counts = None
            batch = None
            frames.tidy()

    texts = frames.doc_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("size", F.length("text").cast("long")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of rows with doc_id and ids: the bytes of all their tokens. Null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for a, b in _runs(batch.column("n_tokens").to_numpy()):
                part = batch.slice(a, b - a)
                said = pa.array(map(own.decode, part.column("ids").to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, said], ["doc_id", "n_tokens", "ids", "decoded"])
                part = said = None
            batch = None
            frames.tidy()

    ids = F.coalesce("ids", F.lit(b""))
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"))
    return rows.mapInArrow(run, DECODED)


def lists(encoded: DataFrame) -> DataFrame:
    """(doc_id, ids) with ids as an array of numbers."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return frames.scan(encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")), kernel, "doc_id long, ids array<int>")
