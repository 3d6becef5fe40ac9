"""Suffix-array dedup: every byte that a string of LENGTH bytes covers which also starts in an earlier document is removed.

Suffixes are sorted by deep-shallow sorting, cut off after LENGTH bytes. To sort few of them, and each in one task with
all that can equal it, they are dealt by anchors. Of a string's grams (GRAM bytes each) the one of least hash is its
anchor, so equal strings have equal anchors at equal places in them. Strings with one anchor stand side by side in a text: a
run, of some SPREAD / 2 strings. Every run is handled in two steps, so that its text is moved only if that can matter:

1. runs as numbers: (anchor, digest of the run's bytes, document, place). A task first joins its own runs of equal
   bytes: the earliest document's goes on, the others are removed. Runs are then dealt by anchor, in buckets whose number
   goes with the bytes of the corpus, and the same is done again over all documents. Anchors that only one document has end here;
2. what is left are runs of several contents around one anchor. Their texts, and no others, are dealt by anchor and their
   suffixes sorted: multikey quicksort (a pivot and a three-way partition by symbols of eight bytes) down to SHALLOW symbols, then
   blind tries, of whose nodes only the symbol on which they branch is looked at. Suffixes that stay equal
   to the end are one string; its earliest document keeps it.

The removed stretches come together by document and are cut out of its text. Texts are dealt once: both joins with them use
one exchange. Anchors with over CROWDED contents are dealt string by string, by the string's hash, after a task has
joined its own equal strings; so neither copies nor phrases that a third of all documents hold make a large group.

Texts are UTF-8 bytes. Texts of over text.SLICE_BYTES are read in pieces that overlap by LENGTH - 1 bytes, so memory
doesn't grow with them. Hashes only deal out and join runs of equal 88 bits (40 of the anchor, 48 of the run's bytes); of documents with
one doc_id and different texts 24 bits of the text's hash tell which is which.

Defined results: a null or empty text has no strings; documents without a doc_id (and those of ids from 2**62 on) come
last, and neither they nor rows of one doc_id count as earlier than each other; repeated rows each give the same row; an
empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text

LENGTH, GRAM = 50, 20
SPREAD = LENGTH - GRAM + 1
#: Bits of a place in what is scanned at once, at most two slices.
PLACE_BITS = 22
#: Symbols of eight bytes that cover a string, and how many of them quicksort looks at.
SYMBOLS = np.array([0, 8, 16, 24, 32, 40, LENGTH - 8])
SHALLOW = 3
#: Bytes of text whose runs a task joins at a time; bytes of the corpus to a bucket; rows of a bucket held before they are joined.
FLUSH_BYTES, BUCKET_BYTES, HELD_ROWS = 8 << 20, 4 << 20, 4_000_000
#: Contents of an anchor from which its strings are dealt one by one.
CROWDED = 1 << 16
SORT_BYTES = 1 << 20
#: Ranks of documents without a doc_id begin here.
NULLS = 1 << 62
KEY_BITS, DIGEST_BITS = 40, 48
#: Flags beside a run's number of strings.
AGAIN, ONE_BY_ONE = 1 << 7, 1 << 8
#: Bytes of a run's columns in a block.
WIDTHS = {"key": 5, "digest": 6, "at": 8, "as": 3, "start": 4, "count": 1, "lead": 1}


def anchored(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of strings with one anchor: text (owner), first string's start, number of strings, the anchor's distance (lead), hash and the run's digest."""
    total = np.maximum(offs[1:] - offs[:-1] - LENGTH + 1, 0)
    if not total.sum():
        return {n: np.zeros(0, np.uint64 if n in ("key", "digest") else np.int64) for n in ("owner", "start", "count", "lead", "key", "digest")}
    sums = np.zeros(data.size + 1, dtype=np.uint64)
    np.cumsum(text.BYTE[data] * text.powers(text.BASE, data.size), out=sums[1:])
    back = text.powers(text.INVERSE, data.size + 1)
    n = data.size - GRAM + 1
    grams = text.mix((sums[GRAM:] - sums[:n]) * back[:n])
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)  # ties go to the first
    step = 1
    while 2 * step <= SPREAD:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if SPREAD > step:
        least = np.minimum(least[: least.size - (SPREAD - step)], least[SPREAD - step :])
    owner = np.repeat(np.arange(offs.size - 1), total)
    start = np.arange(owner.size) + np.repeat(offs[:-1] - (np.cumsum(total) - total), total)
    place = (least[start] & low).astype(np.int64)
    new = np.ones(start.size, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, start.size))
    start, place, owner = start[at], place[at], owner[at]
    digest = text.mix((sums[start + count + LENGTH - 1] - sums[start]) * back[start] + count.astype(np.uint64) * text.STEP)
    return {"owner": owner, "start": start - offs[owner], "count": count, "lead": place - start, "key": text.mix(grams[place]) >> np.uint64(64 - KEY_BITS), "digest": digest >> np.uint64(64 - DIGEST_BITS)}


def runs(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """What ``anchored`` gives for all texts, some at a time, long ones in overlapping pieces."""
    parts = []
    for a, _, d, o in text.slices(data, offs):
        whole = d.size <= 2 * text.SLICE_BYTES
        for s in (0,) if whole else range(0, d.size - LENGTH + 1, text.SLICE_BYTES):
            piece = d if whole else d[s : s + text.SLICE_BYTES + LENGTH - 1]
            found = anchored(piece, o if whole else np.array([0, piece.size]))
            found["owner"] += a
            found["start"] += s
            parts.append(found)
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]} if parts else anchored(data, offs)


def packed(rows: dict[str, np.ndarray]) -> bytes:
    """Columns as planes of bytes, so that bytes that are mostly alike stand together."""
    return b"".join(np.ascontiguousarray(rows[n].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for n, w in WIDTHS.items())


def unpacked(raw: bytes | pa.Buffer) -> dict[str, np.ndarray]:
    n, at, out = len(raw) // sum(WIDTHS.values()), 0, {}
    for name, w in WIDTHS.items():
        wide = np.zeros((n, 8), dtype=np.uint8)
        wide[:, :w] = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T
        out[name], at = wide.view("<u8").ravel().view(np.int64), at + n * w
    return out


def picked(rows: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {n: v[at] for n, v in rows.items()}


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of the columns begins."""
    new = np.ones(columns[0].size, dtype=bool)
    if new.size:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spread(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(first, size)))


def rank(at: np.ndarray) -> np.ndarray:
    return np.minimum(at, NULLS)


def joined(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Runs of equal bytes joined: (those of the earliest document, once for each document; those of later documents)."""
    order = np.lexsort((rows["start"], rows["as"], rows["at"], rows["digest"], rows["key"]))
    rows = picked(rows, order)
    if not order.size:
        return rows, rows
    first = heads(rows["key"], rows["digest"])
    late = rank(rows["at"]) > spread(rank(rows["at"])[first], first, order.size)
    gone, rows = picked(rows, np.flatnonzero(late)), picked(rows, np.flatnonzero(~late))
    first = heads(rows["key"], rows["digest"], rows["at"], rows["as"])
    size = rows["key"].size
    again = np.maximum.reduceat(np.where(rows["start"] != spread(rows["start"][first], first, size), AGAIN, 0) | (rows["count"] & AGAIN), first)
    rows = picked(rows, first)
    rows["count"] |= again
    return rows, gone


def _numbers(bits: int):
    """Blocks of the runs of each flush of texts, by bucket: ("runs") those that go on, ("gone") those that are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text.of_column(batch.column("text"))
            at, as_ = (batch.column(n).to_numpy() for n in ("_at", "_as"))
            for a, b, d, o in text.slices(data, offs, FLUSH_BYTES):
                found = runs(d, o)
                owner = found.pop("owner")
                found = {n: v.view(np.int64) for n, v in found.items()} | {"at": at[a:b][owner], "as": as_[a:b][owner]}
                # Rows whose key and digest no other row has need no sorting.
                both = text.mix(found["key"].view(np.uint64) ^ (found["digest"].view(np.uint64) << np.uint64(16)))
                order = np.argsort(both)
                same = both[order[1:]] == both[order[:-1]]
                twice = np.zeros(order.size, bool)
                twice[order[1:]] |= same
                twice[order[:-1]] |= same
                some, gone = joined(picked(found, np.flatnonzero(twice)))
                left = {n: np.concatenate([v[~twice], some[n]]) for n, v in found.items()}
                bucket = left["key"] >> (KEY_BITS - bits)
                order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                left, bucket = picked(left, order), bucket[order]
                edges = [*heads(bucket).tolist(), bucket.size]
                rows = [(int(bucket[x]), False, packed(picked(left, slice(x, y)))) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                if gone["key"].size:
                    rows.append((int(gone["key"][0]) >> (KEY_BITS - bits), True, packed(gone)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "gone", "block"])
                found = some = gone = left = rows = both = order = None
                frames.tidy()

    return run


FOUND = "_at long, _as long, key long, start long, n int, lead int"


def _spans(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Runs that are removed: no key; n is their length in bytes, lead says whether the text has them again."""
    n, again = (rows["count"] & (AGAIN - 1)) + LENGTH - 1, (rows["count"] & AGAIN) > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["at"]), pa.array(rows["as"]), pa.nulls(n.size, pa.int64()), pa.array(rows["start"]), pa.array(n.astype(np.int32)), pa.array(again.astype(np.int32))],
        ["_at", "_as", "key", "start", "n", "lead"],
    )


def _asked(rows: dict[str, np.ndarray], flags: int = 0) -> pa.RecordBatch:
    """Runs whose bytes are to be sorted."""
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["at"], rows["as"], rows["key"], rows["start"], (rows["count"] | flags).astype(np.int32), rows["lead"].astype(np.int32))], ["_at", "_as", "key", "start", "n", "lead"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of bucket: the runs that are removed, and those whose bytes are to be sorted (see FOUND)."""
    now, held, size, crowded = None, [], 0, np.zeros(0, np.int64)

    def settle(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, crowded
        rows = {n: np.concatenate([h[n] for h in held]) for n in WIDTHS}
        rows, gone = joined(rows)
        if gone["at"].size:
            yield _spans(gone)
        n = rows["key"].size
        of_key = heads(rows["key"])
        contents = heads(rows["key"], rows["digest"])
        several = spread(np.diff(np.append(np.searchsorted(contents, of_key), contents.size)), of_key, n)
        many = (several > CROWDED) | np.isin(rows["key"], crowded)
        if many.any():
            yield _asked(picked(rows, np.flatnonzero(many)), ONE_BY_ONE)
            crowded = np.union1d(crowded, rows["key"][many])
        if last:
            order = rank(rows["at"])
            lo, hi = (spread(f.reduceat(order, of_key), of_key, n) for f in (np.minimum, np.maximum))
            ask = np.flatnonzero((lo < hi) & ~many)
            if ask.size:
                yield _asked(picked(rows, ask))
            held, size, crowded = [], 0, np.zeros(0, np.int64)
        else:
            held = [picked(rows, np.flatnonzero(~many))]
            size = held[0]["key"].size

    joined_at = HELD_ROWS
    for batch in batches:
        for i, (bucket, gone) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if bucket != now:
                if held:
                    yield from settle(True)
                now, joined_at = bucket, HELD_ROWS
                frames.tidy()
            rows = unpacked(batch.column(2)[i].as_buffer())
            if gone:
                yield _spans(rows)
                continue
            held.append(rows)
            size += rows["key"].size
            if size >= joined_at:
                yield from settle(False)
                joined_at = max(HELD_ROWS, 2 * size)
    if held:
        yield from settle(True)


BODIES = "part long, _at long, _as long, start long, n int, lead int, said binary"


def _bodies(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """The bytes of the runs that are asked for; of crowded anchors string by string, joined where a batch has one twice (without bytes: removed)."""
    data, offs = text.of_column(batch.column("text"))
    raw = data.tobytes()
    at, as_ = (batch.column(n).to_numpy() for n in ("_at", "_as"))
    asks = batch.column("asks")
    owner = np.repeat(np.arange(batch.num_rows), np.diff(asks.offsets.to_numpy()))
    key, start, n, lead = (asks.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
    begin, count = offs[owner] + start, n & (AGAIN - 1)
    one = (n & ONE_BY_ONE) > 0
    many = np.flatnonzero(~one)
    columns = [key[many], at[owner[many]], as_[owner[many]], start[many], n[many], lead[many]]
    said = [raw[x:y] for x, y in zip(begin[many].tolist(), (begin[many] + count[many] + LENGTH - 1).tolist(), strict=True)]
    if one.any():
        some = np.repeat(np.flatnonzero(one), count[one])
        inside = np.arange(some.size) - np.repeat(np.cumsum(count[one]) - count[one], count[one])
        first = begin[some] + inside
        part = text.hash_spans(data, first, first + LENGTH).view(np.int64)
        order = np.lexsort((rank(at[owner[some]]), part))
        some, inside, first, part = some[order], inside[order], first[order], part[order]
        group = heads(part)
        who = rank(at[owner[some]])
        goes = who > spread(who[group], group, part.size)
        columns = [np.concatenate(x) for x in zip(columns, [part, at[owner[some]], as_[owner[some]], start[some] + inside, (n[some] & AGAIN) | 1, np.zeros(some.size, lead.dtype)], strict=True)]
        said += [None if g else raw[x : x + LENGTH] for x, g in zip(first.tolist(), goes.tolist(), strict=True)]
    if not said:
        return None
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([*[pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)], pa.array(said, pa.binary())], [f.split()[0] for f in BODIES.split(", ")])


def symbols(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        wide = (wide[:-width] << np.uint64(8 * width)) | wide[width:]
    return wide


class Sorter:
    """Deep-shallow sorting of strings of LENGTH bytes, many groups side by side: ``order`` in the end has them group by group in order."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, groups: np.ndarray):
        self.wide, self.starts = symbols(data), starts
        self.order = np.argsort(groups, kind="stable")
        first = heads(groups[self.order])
        #: For each place in the order, the first place of its group: strings that are equal so far.
        self.group = spread(first, first, starts.size)

    def several(self, at: np.ndarray) -> np.ndarray:
        """Of places that come group by group, those in groups of several."""
        first = heads(self.group[at])
        size = np.diff(np.append(first, at.size))
        return at[np.repeat(size > 1, size)]

    def symbol(self, at: np.ndarray, level) -> np.ndarray:
        return self.wide[self.starts[self.order[at]] + SYMBOLS[level]]

    def quicksort(self) -> np.ndarray:
        """Multikey quicksort to SHALLOW symbols; gives the places whose groups are still equal then."""
        level = np.zeros(self.order.size, dtype=np.int64)
        open_, deep = self.several(np.arange(self.order.size)), []
        while open_.size:
            first = heads(self.group[open_])
            size = np.diff(np.append(first, open_.size))
            value = self.symbol(open_, level[open_])
            a, b, c = value[first], value[first + size // 2], value[first + size - 1]
            pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)  # the median of three
            parts = [value < pivot, value == pivot, value > pivot]
            base, to, group = np.repeat(first, size), np.empty(open_.size, np.int64), np.empty(open_.size, np.int64)
            for mine in parts:
                sums = np.cumsum(mine)
                before = np.repeat(sums[first] - mine[first], size)
                to[mine] = (base + sums - before - 1)[mine]
                group[mine] = base[mine]
                base = base + np.repeat(sums[first + size - 1], size) - before
            self.order[open_[to]] = self.order[open_]
            self.group[open_[to]] = open_[group]
            now = level[open_] + parts[1]
            level[open_[to]] = now
            open_ = self.several(open_)
            down = level[open_] >= SHALLOW
            deep.append(open_[down])
            open_ = open_[~down]
        return np.sort(np.concatenate(deep)) if deep else open_

    def tries(self, at: np.ndarray) -> None:
        """Blind tries, built level by level: a group is a node; it is split by the one symbol on which it first branches, and those before aren't looked at again."""
        while at.size:
            first = heads(self.group[at])
            size = np.diff(np.append(first, at.size))
            branch = np.full(first.size, SYMBOLS.size)
            for level in range(SYMBOLS.size - 1, SHALLOW - 1, -1):
                value = self.symbol(at, level)
                branch[np.maximum.reduceat(value != np.repeat(value[first], size), first)] = level
            node = np.repeat(branch, size)
            at, node = at[node < SYMBOLS.size], node[node < SYMBOLS.size]  # others are leaves: equal to the end
            if not at.size:
                return
            value = self.symbol(at, node)
            by = np.lexsort((value, self.group[at]))
            self.order[at], value, old = self.order[at[by]], value[by], self.group[at]
            first = heads(old, value)
            self.group[at] = spread(at[first], first, at.size)
            at = self.several(at)

    def classes(self) -> np.ndarray:
        """A number per string, equal for equal strings of one group, in their order."""
        self.tries(self.quicksort())
        out = np.empty(self.order.size, dtype=np.int64)
        out[self.order] = self.group
        return out


SPANS = "_at long, _as long, start long, end long, again boolean"


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BODIES in order of part: the stretches that strings cover which an earlier document has."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        bare = rows.column("said").is_null().to_numpy()
        if bare.any():
            yield made(rows, np.flatnonzero(bare), np.zeros(bare.sum(), np.int64), np.ones(bare.sum(), np.int64))
            rows = rows.filter(pa.array(~bare))
        part = rows.column("part").to_numpy()
        first = heads(part)
        size = np.diff(np.append(first, part.size))
        rows = rows.take(pa.array(np.flatnonzero(np.repeat(size > 1, size))))
        if not rows.num_rows:
            return
        said = rows.column("said").combine_chunks().cast(pa.large_binary())
        said = said.chunk(0) if isinstance(said, pa.ChunkedArray) else said
        bounds = np.frombuffer(said.buffers()[1], dtype=np.int64)[said.offset : said.offset + len(said) + 1]
        data, base = np.frombuffer(said.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]], bounds[:-1] - bounds[0]
        count = rows.column("n").to_numpy() & (AGAIN - 1)
        owner = np.repeat(np.arange(count.size), count)
        inside = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
        part = rows.column("part").to_numpy()
        group = spread(np.arange(heads(part).size), heads(part), part.size)
        # Equal strings have their anchor at the same place, so suffixes with different ones needn't be compared.
        classes = Sorter(data, base[owner] + inside, group[owner] * (2 * SPREAD) + SPREAD + rows.column("lead").to_numpy()[owner] - inside).classes()
        who = rank(rows.column("_at").to_numpy())[owner]
        least = np.full(classes.size, NULLS)
        np.minimum.at(least, classes, who)
        at = np.flatnonzero(least[classes] < who)
        if at.size:
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
            yield made(rows, owner[at[new]], inside[at[new]], np.diff(np.append(new, at.size)))

    def made(rows: pa.Table, at: np.ndarray, inside: np.ndarray, strings: np.ndarray) -> pa.RecordBatch:
        here = rows.select(["_at", "_as", "start", "n"]).take(pa.array(at))
        start = here.column("start").to_numpy() + inside
        return pa.RecordBatch.from_arrays([here.column("_at").combine_chunks(), here.column("_as").combine_chunks(), pa.array(start), pa.array(start + strings + LENGTH - 1), pa.array((here.column("n").to_numpy() & AGAIN) > 0)], ["_at", "_as", "start", "end", "again"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part").to_numpy()
        other = np.flatnonzero(part != part[-1])
        cut = int(other[-1]) + 1 if other.size else 0
        if held and size >= SORT_BYTES and (cut or held[-1].column("part")[-1].as_py() != part[0]):
            yield from settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, size, batch = [], 0, batch.slice(cut)
            frames.tidy()
        held.append(batch)
        size += batch.nbytes
    if held:
        yield from settle(pa.Table.from_batches(held))


def everywhere(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of a text wherever the text has their runs."""
    found = runs(data, np.array([0, data.size]))
    key = text.mix(found["key"] ^ (found["digest"] << np.uint64(16)))
    order = np.argsort(key, kind="stable")
    own = np.searchsorted(found["start"], begin, side="right") - 1
    lo, hi = (np.searchsorted(key[order], key[own], side=s) for s in ("left", "right"))
    which = np.repeat(np.arange(own.size), hi - lo)
    like = order[np.arange(which.size) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]]
    shift = found["start"][like] - found["start"][own[which]]
    return begin[which] + shift, end[which] + shift


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = text.of_column(batch.column("text"))
    listed = batch.column("spans").fill_null([])
    count = np.diff(listed.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), count)
    begin, end, again = (listed.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
    if (some := np.flatnonzero(again)).size:
        edges = [*heads(row[some]).tolist(), some.size]
        more = [(row[some[x]], *everywhere(data[offs[row[some[x]]] : offs[row[some[x]] + 1]], begin[some[x:y]], end[some[x:y]])) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        row = np.concatenate([row, *[np.full(x.size, i) for i, x, _ in more]])
        begin, end = np.concatenate([begin, *[x for _, x, _ in more]]), np.concatenate([end, *[y for _, _, y in more]])
    # Stretches of all texts at once, with a byte between texts so that they don't touch.
    order = np.argsort(begin + offs[row] + row)
    row, begin, end = row[order], begin[order], end[order]
    shift = offs[row] + row
    upto = np.maximum.accumulate(end + shift) if row.size else row
    first = np.flatnonzero(np.r_[True, (begin + shift)[1:] > upto[:-1]]) if row.size else row
    start, stop, owner = begin[first], np.append(upto[first[1:] - 1], upto[-1:]) - shift[first], row[first]
    bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    removed = np.bincount(owner, weights=stop - start, minlength=batch.num_rows).astype(np.int64)
    digest, raw = [], memoryview(np.ascontiguousarray(data))
    for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        keep, at = hashlib.sha256(), lo
        for k in range(bounds[i], bounds[i + 1]):
            keep.update(raw[at : lo + start[k]])
            at = lo + int(stop[k])
        keep.update(raw[at:hi])
        digest.append(keep.hexdigest())
    spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "end"]))
    made = [pa.array(np.diff(offs)), pa.array(removed), pa.array(np.diff(bounds)), pa.array(digest, pa.string()), spans]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (array of start, end in bytes) of each row of docs."""
    own = F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text", F.lit("document")), 2) + F.lit(NULLS))
    rows = frames.doc_columns(docs, "doc_id", "text").withColumns({"_at": own, "_as": F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFF))})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(32, max(3, (int(size) // BUCKET_BYTES).bit_length()))
    blocks = rows.select("_at", "_as", "text").mapInArrow(_numbers(bits), "bucket long, gone boolean, block binary")
    found = frames.keep(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_buckets, FOUND), "runs")

    del blocks
    frames.release(docs.sparkSession)
    texts = rows.select("_at", "_as", "doc_id", "text").repartition("_at", "_as")
    asks = found.where("key is not null").groupBy("_at", "_as").agg(F.collect_list(F.struct("key", "start", "n", "lead")).alias("asks"))
    bodies = frames.scan(texts.join(asks, ["_at", "_as"]).select("_at", "_as", "doc_id", "text", "asks"), _bodies, BODIES)
    later = bodies.repartition("part").sortWithinPartitions("part").mapInArrow(_sorted, SPANS)
    outright = found.where("key is null").select("_at", "_as", "start", (F.col("start") + F.col("n")).alias("end"), (F.col("lead") > 0).alias("again"))
    spans = outright.union(later).groupBy("_at", "_as").agg(F.collect_list(F.struct("start", "end", "again")).alias("spans"))
    done = texts.join(spans, ["_at", "_as"], "left").select("_at", "_as", "doc_id", "text", "spans")
    return frames.scan(done, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
