import hashlib
import random

import numpy as np

from tests.llm import hard
from vesper.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def brute(rows):
    first = {}
    rank = lambda d: (d is None, d or 0)
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, rank(d)), rank(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, dtype=np.int8)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < rank(d):
                gone[p + 1 : p + 51] = 1
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs):
    got = sorted((tuple(r)[:5] for r in suffix_dedup.dedup(docs).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_as_brute_force(spark):
    check(hard.sample(spark))
    check(hard.documents(spark))


def test_overlaps_periods_and_borders(spark):
    rnd = random.Random(4)
    source = "".join(rnd.choice("abcdé \n") for _ in range(4000))
    rows = [(i, "".join(source[a : a + rnd.choice([20, 44, 49, 50, 51, 80, 300])] for a in (rnd.randrange(3900) for _ in range(6)))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "ab" * 90), (102, "x" + "ab" * 24 + "a"), (103, "the " * 100), (99, "the " * 14), (104, "z" * 49), (105, "z" * 50), (106, "z" * 51)]
    rnd.shuffle(rows)
    check(spark.createDataFrame(rows, SCHEMA))


def test_sorter_orders_each_group():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[1000:1400] = data[200:600]
    starts, groups = rng.permutation(2900), rng.integers(0, 7, 2900)
    classes = suffix_dedup.Sorter(data, starts, groups).classes()
    cut = [(int(g), data[s : s + 50].tobytes()) for s, g in zip(starts, groups, strict=True)]
    by = sorted(zip(classes.tolist(), cut, strict=True))
    assert [c for _, c in by] == sorted(cut) and len(set(classes.tolist())) == len(set(cut))


def test_blocks_read_back():
    rng = np.random.default_rng(3)
    rows = {n: rng.integers(0, 1 << min(62, 8 * w), 50) for n, w in suffix_dedup.WIDTHS.items()}
    found = suffix_dedup.unpacked(suffix_dedup.packed(rows))
    assert all((found[n] == rows[n]).all() for n in rows)


def shared_phrases(n):
    """Documents with a phrase in common whose surroundings all differ, as whole texts and within them."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    phrase = "this very phrase of forty odd bytes is everywhere in it"
    return [(i if i % 7 else None, f"{word()} {word()} {word()} {phrase} {word()} {word()} " * rnd.choice([1, 1, 3]) + f"{phrase} {rnd.choice('ab')} ends alike for a good many bytes here") for i in range(n)]


def test_crowded_anchors_long_texts_and_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 3)
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", 40)
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup.text, "SLICE_BYTES", 400)
    rows = shared_phrases(60) + shared_phrases(3)[1:] + [(500, "ab" * 900), (501, "x" + "ab" * 700), (2, "one id and two texts, this is the second of them: " + "ab" * 40)]
    packages = kernels(suffix_dedup, rows)
    assert packages == brute(rows)


def kernels(module, rows):
    """dedup's steps in this process, so that constants can be set; parts are grouped as exchanges group them."""
    import pyarrow as pa

    def as_(t):
        return int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:3], "big")

    table = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    at = [d if d is not None else module.NULLS + as_(t) for d, t in rows]
    table = table.append_column("_at", pa.array(at, pa.int64())).append_column("_as", pa.array([as_(t) for _, t in rows], pa.int64()))
    blocks = pa.Table.from_batches(list(module._numbers(3)(iter(table.to_batches(max_chunksize=13))))).sort_by("bucket")
    found = pa.Table.from_batches(list(module._buckets(iter(blocks.to_batches(max_chunksize=5)))))
    rows_found = found.to_pylist()
    asks, spans = {}, {}
    for r in rows_found:
        if r["key"] is not None:
            asks.setdefault((r["_at"], r["_as"]), []).append({k: r[k] for k in ("key", "start", "n", "lead")})
        else:
            spans.setdefault((r["_at"], r["_as"]), []).append({"start": r["start"], "end": r["start"] + r["n"], "again": r["lead"] > 0})
    kind = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("lead", pa.int32())]))
    asked = table.append_column("asks", pa.array([asks.get((a, s), []) for a, s in zip(table["_at"].to_pylist(), table["_as"].to_pylist(), strict=True)], kind))
    bodies = [m for b in asked.to_batches(max_chunksize=17) if (m := module._bodies(b)) is not None]
    later = module._sorted(iter(pa.Table.from_batches(bodies).sort_by("part").to_batches(max_chunksize=11)))
    for r in (r for b in later for r in b.to_pylist()):
        spans.setdefault((r["_at"], r["_as"]), []).append({k: r[k] for k in ("start", "end", "again")})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("again", pa.bool_())]))
    whole = table.append_column("spans", pa.array([spans.get((a, s)) for a, s in zip(table["_at"].to_pylist(), table["_as"].to_pylist(), strict=True)], kind))
    out = [r for b in whole.to_batches() for r in module._cut(b).to_pylist()]
    return sorted((tuple(r.values())[:5] for r in out), key=str)


def test_empty_table(spark):
    assert suffix_dedup.dedup(hard.empty(spark)).collect() == []
