import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tests.llm import hard
from vesper.llm import frames, jaccard, links

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    where = defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g]}:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
        for g in s:
            where[g].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)] += [] if d is None else [d]
    return sorted(((d, len(s), min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(docs, k, percent):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in jaccard.join(docs, k, percent).collect()), key=str) == brute(rows, k, percent)


def test_as_brute_force(spark):
    check(hard.documents(spark), 4, 85)
    check(hard.sample(spark), 4, 85)


def test_near_copies_of_many_degrees(spark):
    rnd = random.Random(5)
    common = " ".join(f"c{i}" for i in range(30))
    rows = []
    for base in range(6):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([12, 60, 300]))]
        for _ in range(40):
            copy = list(words)
            for _ in range(rnd.randrange(1 + len(words) // 12)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(9000)}"
            rows.append((len(rows), " ".join(copy[: len(copy) - rnd.randrange(3)]) + (" " + common) * rnd.randrange(2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, 4, 85)
    check(docs, 5, 80)


def test_empty_table(spark):
    assert jaccard.join(hard.empty(spark)).collect() == []


def test_components_of_a_long_chain(spark):
    rows = [(i + 1, i) for i in range(300)] + [(1000, 1001), (5, 5)]
    found = {r.node: r.root for r in links.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000}
    assert frames.shared_dir(spark)


def test_crowded_tiles_by_group_by_tile_and_by_band():
    rng, percent = np.random.default_rng(3), 85
    sets, keys = [], []
    for base in range(3):
        stock = rng.integers(1, 1 << 60, 90 + 60 * base).astype(np.uint64)
        for _ in range(30):
            own = stock.copy()
            at = rng.integers(0, own.size, rng.integers(0, own.size // 8))
            own[at] = rng.integers(1, 1 << 60, at.size).astype(np.uint64)
            sets.append(np.unique(own))
            keys.append(sorted({base * 10 + int(x) for x in rng.integers(0, 3, 2)} | {99} | ({base} if rng.integers(2) else set())))
    comp = rng.integers(0, 60, len(sets))
    size = np.array([s.size for s in sets])
    at = np.floor(np.log(size) / np.log(100 / percent) / 1.000001).astype(np.int64)
    linked = lambda i, j: 100 * np.intersect1d(sets[i], sets[j]).size >= percent * np.union1d(sets[i], sets[j]).size
    wanted = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if comp[i] != comp[j] and set(keys[i]) & set(keys[j]) and linked(i, j)}
    assert len(wanted) > 50

    def found(rows, percent=percent):
        rows.sort(key=lambda r: r[:2])
        gid, band, i = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        bits = [jaccard.signature(sets[x], jaccard.WIDER) for x in i]
        table = pa.table({"gid": gid, "band": band, "sid": i, "size": size[i], "comp": comp[i], "at": at[i], "bits": pa.array(bits, pa.binary()), "keys": pa.array([keys[x] for x in i], pa.list_(pa.int64()))})
        out = [tuple(p.values()) for b in jaccard._crossing(percent)(iter(table.to_batches(max_chunksize=17))) for p in b.to_pylist()]
        return out, {p for p in out if linked(*p)}

    n = range(len(sets))
    whole, links_whole = found([(7, jaccard.WHOLE, i) for i in n])
    tiles, links_tiles = found([(k, jaccard.TILE, i) for i in n for k in keys[i]])
    bands, links_bands = found([(k, b, i) for i in n for k in keys[i] for b in (int(at[i]), int(at[i]) + 1)])
    assert links_whole == links_tiles == links_bands == wanted
    assert len(set(tiles)) == len(tiles) and len(whole) < 2 * len(wanted) + 50


def test_links_between_size_bands_of_a_large_tile(spark, monkeypatch):
    rnd = random.Random(9)
    passage = [f"passage-of-long-words-{i:02}" for i in range(23)]  # its shingles are the longest: all that any set lists
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    least = passage + own(85)
    between = [passage + own(n) for n in range(86, 95) for _ in range(2)]
    rows = [(i, " ".join(w)) for i, w in enumerate([least, *between, least + own(10)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    band = lambda n: int(np.log(n) / np.log(100 / 85) / 1.000001)
    assert band(105) + 1 == band(115) and jaccard.NEAR <= len(between)
    assert [c for _, _, c in sorted(brute(rows, 4, 85))] == [*range(len(rows) - 1), 0]
    for group in (jaccard.GROUP, 1):
        monkeypatch.setattr(jaccard, "GROUP", group)
        check(docs, 4, 85)
