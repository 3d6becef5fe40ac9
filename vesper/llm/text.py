"""Byte-level text kernels: whole Arrow batches of texts are handled as one numpy array of UTF-8 bytes.

A text column's Arrow buffers are used as they are, so no Python string is made. All functions take
``data`` (uint8) and ``offs`` (int64, one more than there are texts, offs[0] == 0).
Nulls are texts without bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; keeps the working arrays in cache and memory flat. A longer text is handled alone.
SLICE_BYTES = 1 << 20

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit; one to one."""
    h = np.asarray(h, dtype=U64).copy()
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    if (have := _powers.get(base)) is None or have.size < n:
        size = max(n, 2 * SLICE_BYTES)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
        if size > 8 * SLICE_BYTES:
            _powers.pop(base)
    return have[:n]


def of_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offs) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    offs = np.frombuffer(bounds, dtype=kind)[at : at + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, data, offs) of runs of texts with about ``most`` bytes (SLICE_BYTES); every text is whole."""
    at, n, most = 0, offs.size - 1, most or SLICE_BYTES
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1))
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_spans(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that aren't gaps), and for each text the index of its first word (one more than texts)."""
    word = ~gaps[data]
    first, last = word.copy(), word.copy()
    if data.size:
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = offs[1:] > offs[:-1]
        heads, tails = offs[:-1][full], offs[1:][full] - 1
        first[heads], last[tails] = word[heads], word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all texts, and each text's first line; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offs, breaks, side="right") - 1
    first = np.zeros(offs.size, dtype=np.int64)
    np.cumsum(np.bincount(owner, minlength=offs.size - 1) + 1, out=first[1:])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[first[:-1]], ends[first[1:] - 1] = offs[:-1], offs[1:]
    place = np.arange(breaks.size) + owner
    ends[place], starts[place + 1] = breaks, breaks + 1
    return starts, ends, first


STEP, LENGTH_STEP = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
#: Keeps the first n of a symbol's eight bytes.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


def places(n: int, seed: int = 0) -> np.ndarray:
    """A number for each place 0 .. n - 1 of a sequence, by a seed."""
    return mix((np.arange(n, dtype=U64) + U64(1)) * STEP + U64(seed))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they are.

    A span is read as symbols of eight bytes from its start. Each is mixed with its place before they are added up, so
    no algebra holds between strings, as it does for polynomials modulo 2**64; the length comes in last.
    """
    size = ends - starts
    if not size.size:
        return np.zeros(0, dtype=U64)
    padded = np.zeros(data.size + 8, dtype=np.uint8)
    padded[: data.size] = data
    wide = np.ndarray((data.size + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at = places(8, seed)
    total = mix((wide[starts] & FIRST[np.minimum(size, 8)]) + at[0])
    for j in range(1, 8):
        some = np.flatnonzero(size > 8 * j)
        if not some.size:
            break
        total[some] += mix((wide[starts[some] + 8 * j] & FIRST[np.minimum(size[some] - 8 * j, 8)]) + at[j])
    long = np.flatnonzero(size > 64)
    if long.size:
        count = (size[long] - 64 + 7) >> 3
        first = np.cumsum(count) - count
        j = np.arange(int(count.sum())) - np.repeat(first, count) + 8
        begin, left = np.repeat(starts[long], count) + 8 * j, np.repeat(size[long], count) - 8 * j
        total[long] += np.add.reduceat(mix((wide[begin] & FIRST[np.minimum(left, 8)]) + places(int(j.max()) + 1, seed)[j]), first)
    return mix(total ^ (size.astype(U64) * LENGTH_STEP))


def hash_runs(hashes: np.ndarray, first: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run of hashes; runs begin at ``first`` (increasing, from 0) and follow each other."""
    if not first.size:
        return np.zeros(0, dtype=U64)
    count = np.diff(np.append(first, hashes.size))
    j = np.arange(hashes.size) - np.repeat(first, count)
    total = np.add.reduceat(mix(hashes + places(int(j.max()) + 1, seed)[j]), first)
    return mix(total ^ (count.astype(U64) * LENGTH_STEP))


def windows(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each window of k words within a text, in order.

    With ``short``, a text of 1 to k-1 words has its whole sequence as one window.
    """
    n = hashes.size
    count = np.diff(first)
    end = np.repeat(first[1:], count)
    at = np.arange(n)
    keep = at + k <= end
    if short:
        few = (count > 0) & (count < k)
        keep[first[:-1][few]] = True
    at = at[keep]
    end = end[keep]
    total = np.zeros(at.size, dtype=U64)
    for j in range(k):
        inside = at + j < end
        term = hashes[np.minimum(at + j, n - 1)] * U64((0x9E3779B97F4A7C15 * (2 * j + 3)) & ((1 << 64) - 1))
        total += term if not short else np.where(inside, term, U64(j + 1))
        total ^= total >> U64(29)
    return mix(total), at
