"""Repairs against a search over all edit sequences, row by row in plain Python; segments, ties, nulls, copies."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vesper.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code != 0:
            out += [(conv, turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)] * (2 if code == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, audit, repaired) over all ways, by states of what has been said so far."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    ways = {"": (0, "", ())}

    def better(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def opened(ways):
        for _ in range(2):
            more = dict(ways)
            for state, (cost, audit, said) in ways.items():
                for role in ("user", "assistant"):
                    if (state, role[0]) in after:
                        better(more, after[state, role[0]], (cost + 5, audit + "I", (*said, f"{role}:")))
            ways = more
        return ways

    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        to = {}
        for state, (cost, audit, said) in opened(ways).items():
            better(to, state, (cost + 2, audit + "D", said))
            if mark in ("blank", "duplicate"):
                continue
            more = 5 * (mark == "truncated")
            if (state, role[:1]) in after:
                better(to, after[state, role[:1]], (cost + more, audit + "K", (*said, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if (state, new[0]) in after:
                    better(to, after[state, new[0]], (cost + more + 1, audit + "R", (*said, f"{new}:{text}")))
        ways = to
    return min(w[:2] + (w[2],) for s, w in opened(ways).items() if s in ("", "a"))


def expected(rows, damage=True):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        mine = ordered(broken(mine) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in mine])
        marks, times = faults(mine), {t for _, t, _, _ in mine if t is not None}
        cost, audit, said = cheapest(mine, marks)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(times) - min(times) + 1 - len(times) if times else 0
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


def got(rows):
    plans, made = repair.repair(rows, whole=True)
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r) for r in repair.report(plans, made).select(*names).collect()), key=str)


def made(rnd, conversations, most=14, roles=("user", "assistant", "system", "user", "assistant", "tool", "", None)):
    texts = ["Yes.", "No!", "Why?", "cut off", " ", "", None, "one. two", "Well...\n", "été."]
    rows = []
    for c in range(conversations):
        turn = rnd.choice([0, 0, 5, -3])
        for _ in range(rnd.randrange(most)):
            rows.append((c, turn, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.randrange(10**6)}" + rnd.choice([".", "", "!"])))
            turn = rnd.choice([turn + 1, turn + 1, turn + 2, None]) if turn is not None else None
            if turn is None:
                turn = rnd.choice([None, 7, 8])
    return rows


@pytest.mark.parametrize("segment", [256, 3, 1])
def test_damaged_rows_are_repaired_as_by_search(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rnd = random.Random(segment)
    rows = made(rnd, 60) + made(rnd, 1, 120)
    rows = [(None if c == 7 else c, *r) for c, *r in rows]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(repair.damaged(frame)) == expected(rows)
    assert got(repair.turns(frame)) == expected(rows, damage=False)


def test_copies_of_a_row_are_one_row(spark):
    rows = [(1, t, r, x) for t, r, x in [(0, "user", "Hi."), (1, "assistant", "Yes."), (2, "user", "cut")] for _ in range(9)] + [(2, 0, "user", " ")] * 5 + [(3, None, "user", "A.")] * 3
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(repair.turns(frame)) == expected(rows, damage=False)
    audits = {r[0]: r[7] for r in got(repair.turns(frame))}
    assert audits[1] == "K" + "D" * 8 + "K" + "D" * 17 and audits[2] == "DDDDD"


def test_lost_conversations_empty_tables_and_clashing_names(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(dropped, 0, "user", "Hi."), (-5, 0, "user", "Yes."), (-5, 1, "assistant", "No.")], SCHEMA)
    for name in ("copies", "said", "segment", "place", "first", "_code", "a.b"):
        frame = frame.withColumn(name, F.lit(3))
    rows = {r[0]: r for r in got(repair.damaged(frame))}
    assert rows[dropped] == (dropped, 0, 0, 0, 0, 0, 0, "", EMPTY)
    assert got(repair.damaged(frame.where("false"))) == []
    _, made_rows = repair.repair(repair.turns(frame.where("conv_id = -5")))
    assert [(r.role, r.text, r.edit) for r in made_rows.orderBy("segment", "nth").collect()] == [("user", "Yes.", "K"), ("assistant", "No.", "K")]


def test_a_long_conversation_is_in_many_groups(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"text {t}.") for t in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    parts = repair.segments(repair.faults(repair.turns(frame)))
    assert sorted(r.n for r in parts.select(F.size("rows").alias("n")).collect()) == [184] + [256] * 11
    assert got(repair.turns(frame)) == expected(rows, damage=False)
    made_rows = [repair.repair(repair.turns(frame), whole)[1].orderBy("segment", "nth").collect() for whole in (False, True)]
    assert made_rows[0] == made_rows[1] and len({r.segment for r in made_rows[0]}) == 12


def test_main_path_is_native(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA)
    parts = repair.segments(repair.faults(repair.damaged(frame)))
    said = repair.edits(parts, repair.plan(parts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in said and "InArrow" not in said


def test_query_is_the_search(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert sorted((tuple(r) for r in queries.op13_conversation_repair(spark, "/root/testdata/sf0.001").select(*names).collect()), key=str) == expected(rows)


def test_sql_is_the_search():
    import pandas as pd

    from tests.llm import duck

    rnd = random.Random(17)
    rows = [(None if c == 7 else c, *r) for c, *r in made(rnd, 80)]
    names, found = duck.rows(repair.ORACLE, conversations=pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    order = [names.index(n) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]
    assert sorted((tuple(r[i] for i in order) for r in found), key=str) == expected(rows)
