"""Best-fit packing of token sequences by bin completion.

Documents become token ids and an end id; those longer than a sequence are cut into pieces of its length, the first
piece being what is over. Lengths are then all that packing needs: the counts of the 1..capacity lengths, a table
whose size doesn't depend on the input, are summed by Spark and packed on the driver:

* bins are filled around the longest piece left. All its fillings, of any number of pieces, are enumerated one at a time, fullest
  first, without those that another piece still fits into or that another dominates (its pieces can take the other's, group by group);
* a filling is used as often as the counts allow, so equal bins cost one step, and then, on the way back, less often;
* best-fit decreasing gives the first incumbent; branches whose waste or lower bound exceeds what the incumbent, less one bin,
  allows are pruned, first with NARROW fillings a step for half of the steps, then with all; a completed branch with fewer bins becomes the incumbent. The search ends when all is tried, at the lower bound
  (tokens over capacity, or for any k the pieces over 1/(k+1) of it, of which a bin holds k, rounded up) or after
  MAX_NODES steps, with the best found.

The plan (runs of equal bins, a few rows for each length) is what tasks get; each piece finds its place by its
running number among pieces of its length, from counts by task and length. No piece is moved for that.

Defined results: a null or empty text has its end id alone, a piece of one token; repeated rows and null doc_ids
are packed row by row; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import frames, tokens

#: Steps of the search on the driver; each looks at a filling for a run of equal bins.
MAX_NODES = 20_000
#: Fillings are held against so many others, if of so many pieces at most. More would only prune more.
COMPARED, FEW = 32, 8
#: Fillings at a step of the first search; the second tries all.
NARROW = 6


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on counts: runs (bins, lengths)."""
    left, runs = counts.copy(), []
    while (tops := np.flatnonzero(left)).size:
        bin_, room = [], capacity
        work = left.copy()
        while True:
            fits = np.flatnonzero(work[: room + 1])
            if not fits.size:
                break
            bin_.append(int(fits[-1]))
            work[fits[-1]] -= 1
            room -= int(fits[-1])
        del tops
        runs.append((take(left, bin_), tuple(bin_)))
    return runs


def take(left: np.ndarray, lengths) -> int:
    """Takes the filling from the counts as often as they have it."""
    need: dict[int, int] = {}
    for x in lengths:
        need[x] = need.get(x, 0) + 1
    times = min(int(left[x]) // n for x, n in need.items())
    for x, n in need.items():
        left[x] -= times * n
    return times


def dominated(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Can the pieces of ``small`` be grouped so that each group fits into a piece of ``large`` of its own?"""
    if not small:
        return True
    rooms = set()
    for i, room in enumerate(large):
        if room not in rooms and small[0] <= room:
            rooms.add(room)
            if dominated(small[1:], (*large[:i], room - small[0], *large[i + 1 :])):
                return True
    return False


def fillings(left: np.ndarray, first: int, capacity: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated ways to fill a bin that holds ``first``, fullest first; None for one that is passed over. ``left`` still counts first."""
    room = capacity - first
    have = left[: room + 1].copy()
    if first <= room:
        have[first] -= 1
    sizes = np.flatnonzero(have).tolist()
    if not sizes or have[room]:  # a piece of just the room dominates all
        yield (room,) if sizes else ()
        return
    most = [min(int(have[x]), room // x) for x in sizes]
    # Bit s of reach[i]: the first i lengths can make the sum s.
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x, n in zip(sizes, most, strict=True):
        sums, part = reach[-1], 1
        while n:
            part = min(part, n)
            sums |= sums << part * x & mask
            n, part = n - part, 2 * part
        reach.append(sums)

    def making(total: int, i: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """(length, times) of each choice among the first i lengths with that sum, longest pieces first."""
        if not total:
            yield ()
            return
        for j in range(min(i, bisect_right(sizes, total)) - 1, -1, -1):
            if not reach[j + 1] >> total & 1:
                return
            for n in range(min(most[j], total // sizes[j]), 0, -1):
                if reach[j] >> (total - n * sizes[j]) & 1:
                    for more in making(total - n * sizes[j], j):
                        yield ((sizes[j], n), *more)

    kept: list[tuple[int, ...]] = []
    for total in range(room, 0, -1):
        if not reach[-1] >> total & 1:
            continue
        for choice in making(total, len(sizes)):
            taken = dict(choice)
            if any(have[x] > taken.get(x, 0) for x in itertools.takewhile(lambda x: x <= room - total, sizes)):
                yield None
                continue
            f = tuple(x for x, n in choice for _ in range(n))
            if len(f) <= FEW:
                if any(dominated(f, g) for g in kept):
                    yield None
                    continue
                if len(kept) < COMPARED:
                    kept.append(f)
            yield f


def branches(left: np.ndarray, capacity: int, less: bool) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """Steps (bins, lengths) around the longest piece left: each filling as often as it goes, or each less often."""
    top = int(np.flatnonzero(left)[-1])
    for f in fillings(left, top, capacity):
        if f is None:
            yield None
        else:
            often = take(left.copy(), (top, *f))
            for times in range(often - 1, 0, -1) if less else (often,):
                yield times, (top, *f)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    k = np.arange(1, capacity + 1)
    longer = np.cumsum(counts[::-1])[::-1][capacity // (k + 1) + 1]  # a bin holds k pieces of over capacity / (k + 1)
    return max(-(-int((counts * np.arange(counts.size)).sum()) // capacity), int((-(-longer // k)).max()))


def bin_completion(counts: np.ndarray, capacity: int, max_nodes: int = MAX_NODES) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (bins, lengths in a bin) that pack ``counts[length]`` pieces of each length; counts has capacity + 1 entries."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int((counts * np.arange(counts.size)).sum())
    incumbent = best_fit(counts, capacity)
    bins, least = sum(n for n, _ in incumbent), lower_bound(counts, capacity)
    nodes = 0

    def tried(left: np.ndarray, narrow: bool) -> list[Iterator]:
        if narrow:
            return [itertools.islice(filter(None, itertools.islice(branches(left, capacity, False), 4 * NARROW)), NARROW)]
        return [branches(left, capacity, less) for less in (True, False)]

    # A narrow search climbs back further; the second, of all branches, has the rest of the steps.
    for narrow, end in ((True, max_nodes // 2), (False, max_nodes)):
        # Depth first: what is left, the runs so far as a linked list, their bins, their waste, and the steps yet to try.
        stack = [(counts, None, 0, 0, steps) for steps in tried(counts, narrow)] if total else []
        while stack and bins > least and nodes < end:
            left, runs, used, waste, steps = stack[-1]
            nodes += 1
            if (step := next(steps, ())) is None:
                continue
            most = (bins - 1) * capacity - total - waste
            if not step or capacity - sum(step[1]) > most:  # later steps waste no less
                stack.pop()
                continue
            times, lengths = step
            lost = times * (capacity - sum(lengths))
            if lost > most:
                continue
            now = left.copy()
            for x in lengths:
                now[x] -= times
            if used + times + lower_bound(now, capacity) >= bins:
                continue
            after = (runs, step)
            if now.any():
                stack += [(now, after, used + times, waste + lost, steps) for steps in tried(now, narrow)]
            else:
                bins, incumbent = used + times, []
                while after:
                    after, run = after
                    incumbent.append(run)
    return incumbent


def layout(runs: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first number, bins, first bin, offset): where the pieces of a length go, by their running number."""
    used: dict[int, int] = {}
    rows, bin_ = [], 0
    for bins, lengths in runs:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), bins, bin_, offset))
            used[x] = used.get(x, 0) + bins
            offset += x
        bin_ += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth")])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """A row per piece, numbered within its task among those of its length; with_ids adds ids (array of int)."""
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode = TaskContext.get().partitionId(), tokens.encoder(tokenizer).encode
        numbers = [0] * (capacity + 1)
        for batch in batches:
            owner, rows, ids = [], [], []
            for i, said in enumerate(batch.column("text").to_pylist()):
                raw = encode(said or "") + end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    owner.append(i)
                    rows.append((k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), task, numbers[b - a]))
                    numbers[b - a] += 1
                    if with_ids:
                        ids.append(np.frombuffer(raw[4 * a : 4 * b], dtype="<u4").astype(np.int32))
            columns = [pa.array(x) for x in np.array(rows, dtype=np.int64).reshape(-1, 6).T]
            made = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *columns]
            yield pa.RecordBatch.from_arrays([*made, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], schema.names)

    return frames.doc_columns(docs, "doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece of docs."""
    cut = frames.keep(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    by_task = frames.keep(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    summed = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in summed:
        counts[length] = n
    plan = layout(bin_completion(counts, capacity))
    before = by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("task", "length", F.coalesce("base", F.lit(0)).alias("base"))
    numbered = cut.join(before, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", *(["ids"] if with_ids else [])]

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
        # Rows of the plan are in the order (length, first number).
        at = np.searchsorted(plan[:, 0] * (1 << 44) + plan[:, 1], length * (1 << 44) + nth, side="right") - 1
        sequence, offset = plan[at, 3] + (nth - plan[at, 1]) % plan[at, 2], plan[at, 4]
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names if n != "nth"], pa.array(sequence), pa.array(offset)], [*[n for n in names if n != "nth"], "sequence_id", "offset"])

    out = "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    done = frames.scan(numbered.select(*names), placed, out)
    return done.withColumn("piece", F.col("piece").cast("int"))
