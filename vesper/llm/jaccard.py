"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, and their components.

Method: documents meet in tiles (a rare shingle and a band of set sizes). In a tile, hashed bitmap
signatures bound each overlap from above by bit counts; what the bound lets pass is settled by an exact
intersection of sorted arrays. Steps, each a plain DataFrame job:

1. scan the texts for set sizes, set digests and signatures, and for the shingles that many documents hold
   (a table of 2**20 counters over all documents, of which only the heavy ones leave a task);
2. scan again for postings: a set of s shingles lists its first s - ceil(t s) + 1 in the order
   (heaviness, longest first, hash). Two sets that reach t share one of these, whatever the order is, so this loses
   nothing; long shingles rarely meet by chance. Sets that are equal count as one from here on;
3. pair each set with the few before it, by size, in each of its tiles: in most tiles these are all pairs. The signatures'
   bound leaves candidates. Of each set's candidates one is settled by exact intersection first; links make
   components, and only candidates between different components are settled after that. Then only crowded tiles that still hold several
   components go on: band by band, pairs of different components that the bound allows are settled the same way.
   Pairs within a component are never made, so a group of n near copies costs some n pairs, not n**2. Texts are moved
   only for sets that have a candidate or are in a crowded tile.

Shingles and sets are held as 64-bit digests, a shingle's led by its length (a set's second digest must agree too when documents are classed).
Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a text of fewer than k words has one shingle, its
sequence; a text without words has none and links with nothing.

Defined results: a null text has no shingles; rows without a doc_id get a row and count as class members, but
never name a component (null if there is no other); repeated rows each give a row; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, links, text

#: Counters for heavy shingles; their classes are a table of this many bytes, however large the input is.
COUNTERS = 1 << 20
#: A counter leaves a task if it is this many times the task's mean, and over HEAVY_LEAST.
HEAVY_TIMES, HEAVY_LEAST = 4, 16
#: How much wider signatures are in crowded tiles, where a looser bound would let pairs through by the square of a tile's sets.
WIDER = 8
#: Groups of crowded tiles whose sets hold up to so many shingles (a byte or two of signature each) go to one task at once.
GROUP = 1 << 26
#: Bands of groups that are compared as a whole, and of single tiles that are.
WHOLE, TILE = -2, -1
#: Pairs of signatures compared at a time, and the 64-bit words of their first look.
BLOCK, COARSE = 1024, 8
#: Tiles of up to so many sets give all their pairs at once; in larger ones each set is first held against as many before it.
NEAR = 8
NOBODY = -(1 << 63)


def sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text, its distinct shingles, longest first: 8 bits of 255 less the bytes in its words, 56 bits of hash."""
    starts, ends, first = text.word_spans(data, offs)
    hashes, at = text.windows(text.hash_spans(text.LOWER[data], starts, ends), first, k, short=True)
    bounds = np.searchsorted(at, first)
    upto = np.zeros(starts.size + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=upto[1:])
    end = np.minimum(at + k, np.repeat(first[1:], np.diff(bounds)))
    length = np.minimum(upto[end] - upto[at], 255).astype(np.uint64)
    hashes = (hashes >> np.uint64(8)) | ((np.uint64(255) - length) << np.uint64(56))
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def counter(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(30)).astype(np.int64) & (COUNTERS - 1)


def needed(size, percent: int):
    """The least overlap that a set of this size needs to reach the percentage with any other."""
    return -(-percent * size // 100)


def signature(items: np.ndarray, times: int = 1) -> bytes:
    """A bitmap as wide as the set is large, or so many times (a power of two, 64 bits at least): bit = parity of the items hashed to it."""
    width = max(64, times << int(items.size - 1).bit_length())
    return np.packbits(np.bincount(items.astype(np.int64) & (width - 1), minlength=width) & 1).tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """The signature at a smaller width: parities of halves add up by xor."""
    out = np.frombuffer(bits, dtype=np.uint8)
    while out.size * 8 > width:
        out = out[: out.size // 2] ^ out[out.size // 2 :]
    return out


def may_link(size_a, size_b, differing, percent: int):
    """Does the bound from bit counts allow the pair: the sets differ in at least ``differing`` items."""
    overlap = (size_a + size_b - differing) // 2
    small = np.minimum(size_a, size_b)
    overlap = np.minimum(overlap, small)
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, dtype=np.int64), 0
        for batch in batches:
            data, offs = text.of_column(batch.column("text"))
            n, one, two, bits = [], [], [], []
            for _, _, d, o in text.slices(data, offs):
                for items in sets(d, o, k):
                    raw = items.tobytes()
                    n.append(items.size)
                    one.append(xxhash.xxh3_64_intdigest(raw))
                    two.append(xxhash.xxh64_intdigest(raw, seed=7))
                    bits.append(signature(items) if items.size else b"")
                    counts[counter(items)] += 1
                    seen += items.size
            one, two = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "sid": one, "sid2": two, "bits": pa.array(bits, pa.binary()), "counter": pa.nulls(len(n), pa.int64()), "count": pa.nulls(len(n), pa.int64())})
        heavy = np.flatnonzero(counts > max(HEAVY_LEAST, HEAVY_TIMES * seen / COUNTERS))
        if heavy.size:
            none = pa.nulls(heavy.size, pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "sid": none, "sid2": none, "bits": pa.nulls(heavy.size, pa.binary()), "counter": pa.array(heavy), "count": pa.array(counts[heavy])})

    return run


def _postings(k: int, percent: int, classes: bytes):
    rank = np.frombuffer(classes, dtype=np.uint8)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offs = text.of_column(batch.column("text"))
        done, keys, sids, sizes = set(), [], [], []
        for _, _, d, o in text.slices(data, offs):
            for items in sets(d, o, k):
                if not items.size or (sid := xxhash.xxh3_64_intdigest(items.tobytes())) in done:
                    continue
                done.add(sid)
                length = items.size - needed(items.size, percent) + 1
                weight = rank[counter(items)]
                light = np.flatnonzero(weight == 0)[:length]
                if light.size < length:
                    light = np.argsort(weight, kind="stable")[:length]
                keys.append(items[light])
                sids.append(sid)
                sizes.append((items.size, length))
        if not keys:
            return None
        size, length = np.array(sizes, np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(sids, np.uint64).view(np.int64), length)), pa.array(np.repeat(size, length).astype(np.int32))], ["key", "sid", "size"])

    return kernel


def _tiles(percent: int):
    """Of rows in the order (key, size, sid): each set with up to NEAR - 1 before it in its tile whose size allows a link, as pairs
    (a, b); and the members of tiles with over NEAR sets, as (key, sid, size). Tiles of at most NEAR sets are done with that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paired(key, sid, size, fresh):
            a, b = [], []
            for lag in range(1, NEAR):
                later = np.arange(max(fresh, lag), key.size)
                later = later[(key[later] == key[later - lag]) & (100 * size[later - lag].astype(np.int64) >= percent * size[later])]
                a.append(sid[later - lag])
                b.append(sid[later])
            return np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)

        def crowded(key):
            mark = np.zeros(key.size + 1, dtype=np.int64)
            at = np.flatnonzero(key[NEAR:] == key[:-NEAR])
            np.add.at(mark, at, 1)
            np.add.at(mark, at + NEAR + 1, -1)
            return np.cumsum(mark[:-1]) > 0

        def made(pairs, key, sid, size):
            n, m = pairs.shape[1], key.size
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.zeros(n, np.int64), key])), pa.array(np.concatenate([pairs[0], sid])),
                pa.array(np.concatenate([pairs[1], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n), pa.array(np.concatenate([np.zeros(n, np.int32), size])),
            ], ["key", "a", "b", "size"])

        # Rows that are held: the last NEAR that are done, then up to NEAR whose tile may still turn out to be crowded.
        held, seen, done = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], 0, 0
        for batch in batches:
            key, sid, size = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            again = np.zeros(key.size, bool)
            again[1:] = (key[1:] == key[:-1]) & (sid[1:] == sid[:-1])
            key, sid, size = key[~again], sid[~again], size[~again]
            pairs, full = paired(key, sid, size, seen), crowded(key)
            upto = max(done, key.size - NEAR)
            full[:done] = full[upto:] = False
            yield made(pairs, key[full], sid[full], size[full])
            cut = max(0, upto - NEAR)
            held, seen, done = [key[cut:], sid[cut:], size[cut:]], key.size - cut, upto - cut
        key, sid, size = held
        full = crowded(key)
        full[:done] = False
        yield made(np.zeros((2, 0), np.int64), key[full], sid[full], size[full])

    return run


def _within_bound(percent: int):
    """Keeps the pairs that their signatures allow."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, dtype=bool)
        sizes = (batch.column("na").to_numpy(), batch.column("nb").to_numpy())
        for i, (x, y) in enumerate(zip(batch.column("ba").to_pylist(), batch.column("bb").to_pylist(), strict=True)):
            width = 8 * min(len(x), len(y))
            far = int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())
            keep[i] = may_link(sizes[0][i], sizes[1][i], far, percent)
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return kernel


def _crossing(percent: int):
    """Pairs of sets in different components that a group (gid, band) holds and the signatures allow; size bands decide who is at home.

    A group of band WHOLE is all tiles with the same least component: its sets are compared at once, or tile by tile if that is less work.
    Other groups are one tile (gid is its key), whole (band TILE) or only what one size band has to compare; a pair
    is given there in the least of the keys that both sets list, so no other tile gives it again.
    """

    def bounded(size, comp, home, bits):
        order = np.argsort(comp, kind="stable")
        size, comp, home = size[order], comp[order], home[order]
        width = min(len(x) for x in bits) * 8
        table = np.stack([folded(bits[i], width) for i in order]).view(np.uint64)
        coarse = table
        while coarse.shape[1] > COARSE:
            coarse = coarse[:, : coarse.shape[1] // 2] ^ coarse[:, coarse.shape[1] // 2 :]
        ends = np.searchsorted(comp, comp, side="right")
        for a in range(0, size.size, BLOCK):
            b = min(a + BLOCK, size.size)
            for c in range(int(ends[a]), size.size, BLOCK):
                d = min(c + BLOCK, size.size)
                small, large = np.minimum(size[a:b, None], size[None, c:d]), np.maximum(size[a:b, None], size[None, c:d])
                fit = (100 * small >= percent * large) & (comp[a:b, None] != comp[None, c:d]) & (home[a:b, None] | home[None, c:d])
                x, y = np.nonzero(fit & (np.arange(a, b)[:, None] < np.arange(c, d)[None, :]))
                x, y = x + a, y + c
                for signs in (coarse, table):
                    step = max(1, BLOCK * 1024 // signs.shape[1])
                    differing = [np.bitwise_count(signs[x[i : i + step]] ^ signs[y[i : i + step]]).sum(axis=1, dtype=np.int64) for i in range(0, x.size, step)]
                    if differing:
                        fit = may_link(size[x], size[y], np.concatenate(differing), percent)
                        x, y = x[fit], y[fit]
                if x.size:
                    yield order[x], order[y]

    def tiles(gid, band, keys):
        """The row numbers to compare with each other, and the key that must be a pair's least common one, if any."""
        n = len(keys)
        if band != WHOLE:
            return [(np.arange(n), gid)]
        flat = np.concatenate(keys)
        row = np.repeat(np.arange(n), [len(x) for x in keys])
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        edges = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True])
        if n * n <= (np.diff(edges) ** 2).sum():
            return [(np.arange(n), None)]
        return [(row[a:b], int(flat[a])) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]

    def group(gid, band, sid, size, comp, at, bits, keys):
        listed = [set(x.tolist()) for x in keys]
        for rows, key in tiles(gid, band, keys):
            for home in np.unique(at[rows]) if band in (WHOLE, TILE) else [band]:
                here = rows[(at[rows] == home) | (at[rows] == home - 1)]  # as sets are dealt to their own band and the next
                if here.size < 2 or (comp[here] == comp[here[0]]).all():
                    continue
                for x, y in bounded(size[here], comp[here], at[here] == home, [bits[i] for i in here]):
                    x, y = here[x], here[y]
                    if key is not None:
                        own = np.fromiter((min(listed[i] & listed[j]) == key for i, j in zip(x.tolist(), y.tolist(), strict=True)), dtype=bool, count=x.size)
                        x, y = x[own], y[own]
                    yield np.stack([np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: pa.Table):
            gid, band, sid, size, comp, at = (rows.column(i).to_numpy() for i in range(6))
            bits, keys = rows.column("bits").to_pylist(), rows.column("keys").to_numpy()
            edges = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (band[1:] != band[:-1]), True]) if gid.size else [0]
            found = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in group(int(gid[a]), int(band[a]), sid[a:b], size[a:b], comp[a:b], at[a:b], bits[a:b], keys[a:b])]
            if sum(x.shape[1] for x in found):
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gid, band = batch.column("gid").to_numpy(), batch.column("band").to_numpy()
            last = np.flatnonzero((gid != gid[-1]) | (band != band[-1]))
            cut = int(last[-1]) + 1 if last.size else 0
            if cut or (held and (held[-1].column("gid")[-1].as_py() != gid[0] or held[-1].column("band")[-1].as_py() != band[0])):
                yield from made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
                frames.tidy()
            held.append(batch.slice(cut))
        if held:
            yield from made(pa.Table.from_batches(held))

    return run


def _verify(k: int, percent: int):
    """Keeps the pairs of texts whose sets reach the percentage, by exact intersection of sorted arrays."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        known: dict[int, np.ndarray] = {}

        def load(ids, column):
            fresh = [i for i, s in enumerate(ids) if s not in known and not known.update({s: None})]
            part = column.take(pa.array(fresh, pa.int64()))
            data, offs = text.of_column(part)
            for lo, _, d, o in text.slices(data, offs):
                for j, items in enumerate(sets(d, o, k)):
                    known[ids[fresh[lo + j]]] = items

        left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        load(left, batch.column("ta"))
        load(right, batch.column("tb"))
        keep = []
        for a, b in zip(left, right, strict=True):
            x, y = known[a], known[b]
            both = np.intersect1d(x, y, assume_unique=True).size
            keep.append(100 * both >= percent * (x.size + y.size - both))
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return kernel


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: components of links of ``percent`` or more on k-word shingles."""
    docs = frames.doc_columns(docs, "doc_id", "text")
    scanned = frames.keep(docs.mapInArrow(_digests(k), "doc_id long, n long, sid long, sid2 long, bits binary, counter long, count long"), "sets")
    heavy = scanned.where("counter is not null").groupBy("counter").agg(F.sum("count").alias("count")).toPandas()  # COUNTERS rows at most
    classes = np.zeros(COUNTERS, dtype=np.uint8)
    classes[heavy["counter"].to_numpy(dtype=np.int64)] = np.log2(heavy["count"].to_numpy(dtype=np.float64) + 1).astype(np.uint8)

    digests = scanned.where("counter is null").select("doc_id", "n", "sid", "sid2")
    classed = scanned.where("n > 0").groupBy("sid", "sid2").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("size"), F.first("bits").alias("bits"))
    classed = frames.keep(classed, "classes")

    postings = frames.scan(docs, _postings(k, percent, classes.tobytes()), "key long, sid long, size int")
    tiles = frames.keep(postings.repartition("key").sortWithinPartitions("key", "size", "sid").mapInArrow(_tiles(percent), "key long, a long, b long, size int"), "tiles")
    pairs, crowds = tiles.where("b is not null").select("a", "b").distinct(), tiles.where("b is null").select("key", F.col("a").alias("sid"), "size")

    def side(end: str) -> DataFrame:
        return classed.select(F.col("sid").alias(end), F.col("size").alias(f"n{end}"), F.col("bits").alias(f"b{end}"))

    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ba", "bb")
    near = frames.keep(frames.scan(near, _within_bound(percent), "a long, b long"), "near")

    # The texts of the sets that may have to be settled, each once.
    wanted = near.select(F.explode(F.array("a", "b")).alias("sid")).union(crowds.select("sid")).distinct()
    wanted = wanted.join(classed.select("sid", "first_id"), "sid").select("sid", F.coalesce("first_id", F.lit(NOBODY)).alias("at"))

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text.of_column(batch.column("text"))
        done, keep, bits, said = set(), [], [], batch.column("sid").to_numpy().view(np.uint64)
        for lo, _, d, o in text.slices(data, offs):
            for j, items in enumerate(sets(d, o, k)):
                sid = int(said[lo + j])
                if sid not in done and items.size and xxhash.xxh3_64_intdigest(items.tobytes()) == sid:
                    done.add(sid)  # repeated rows
                    keep.append(lo + j)
                    bits.append(signature(items, WIDER))
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("sid").take(at), batch.column("text").take(at), pa.array(bits, pa.binary())], ["sid", "text", "bits"])

    texts = docs.select(F.coalesce("doc_id", F.lit(NOBODY)).alias("at"), "text").join(wanted, "at").select("sid", "text")
    texts = frames.keep(frames.scan(texts, own, "sid long, text string, bits binary"), "texts")

    def settled(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
        return frames.keep(frames.scan(both.select("a", "b", "ta", "tb"), _verify(k, percent), "a long, b long"), "links")

    def crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """The pairs whose sets aren't in one component."""
        ends = [roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")) for end in ("a", "b")]
        found = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
        return found.where("ra is null or rb is null or ra <> rb").select("a", "b")

    first = settled(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    roots = links.components(first)
    tried = near.groupBy("b").agg(F.min("a").alias("a"))
    rest = crossing(near.join(tried, ["a", "b"], "left_anti"), roots)
    second = settled(rest)
    links_so_far = first.union(second)
    frames.drop(near)
    before, roots = roots, links.components(links_so_far)
    frames.drop(before)

    # What crowded tiles still hold in different components.
    member = crowds.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")
    mixed = member.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("size").alias("tile")).where("lo < hi").select("key", "lo", "tile")
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent)) / 1.000001)
    # Near copies meet in many tiles, most of which have the same least component: there, a set goes once to all of them.
    tile = F.struct("key", (F.col("tile") > GROUP).alias("large"))
    mixed = member.join(mixed, "key").groupBy("lo", "sid").agg(F.first("comp").alias("comp"), F.first("size").cast("long").alias("size"), F.collect_list(tile).alias("tiles"))  # at most a set's own postings
    mixed = frames.keep(mixed.withColumn("at", band), "mixed")
    weights = mixed.groupBy("lo").agg((F.sum("size") > GROUP).alias("large"))
    placed = mixed.join(weights, "lo").withColumn("keys", F.col("tiles.key"))
    whole = placed.where("not large").select(F.col("lo").alias("gid"), F.lit(WHOLE).cast("long").alias("band"), "sid", "size", "comp", "at", "keys")
    apart = placed.where("large").withColumn("tile", F.explode("tiles"))
    bands = F.when(F.col("tile.large"), F.array("at", F.col("at") + 1)).otherwise(F.array(F.lit(TILE).cast("long")))
    apart = apart.select(F.col("tile.key").alias("gid"), F.explode(bands).alias("band"), "sid", "size", "comp", "at", "keys")
    tiled = whole.union(apart).join(texts.select("sid", "bits"), "sid").select("gid", "band", "sid", "size", "comp", "at", "bits", "keys")
    pairs = tiled.repartition("gid", "band").sortWithinPartitions("gid", "band").mapInArrow(_crossing(percent), "a long, b long")
    third = settled(pairs.distinct())
    frames.drop(tiles, mixed, texts)
    before, roots = roots, links.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(third))
    frames.drop(before, first, second, third)

    joined = classed.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = joined.join(least, "root").select("sid", "sid2", "component_id")
    shown = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return digests.join(final, ["sid", "sid2"], "left").select("doc_id", F.col("n").alias("n_shingles"), shown.alias("component_id"))
