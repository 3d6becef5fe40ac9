"""Substring dedup by hashing lines cut into sentences: of equal units anywhere the earliest stays and the rest go.

A unit is a sentence of a line: its words up to one that ends in ``. ! ?`` or to the line's end, if these are at
least ``min_words``. Whole lines alone would miss passages that stand inside paragraphs, as shared passages do. Normalised
(A-Z lower-cased, words joined by single spaces) a unit has a 128-bit digest, two independent 64-bit hashes. Digests are
grouped over all documents with pre-aggregation, so a unit in a third of all documents costs a row per task; the
earliest occurrence is the one of least (doc_id, place). Units are then joined with the repeated digests alone;
adaptive execution splits a hot one.

Offsets are code points of the original text and are retained: ``removed`` has each removed unit's span, from its first
word to its last. The text that is left is the other parts of each line, a part being a sentence with the white space
around it; a line of which nothing is left goes with its line break.

Defined results: a null text stays null and has no units; rows without a doc_id come last in rank; rows of one
doc_id are told apart by their text, and repeated rows (equal in both) count as one, each giving the same row; an
empty table gives an empty table; all other columns of the input are kept as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, text

LAST = (1 << 63) - 1
#: Seed of the second hashes, of words and of units.
SECOND = 0xC2B2AE3D27D4EB4F
CONTINUES = (np.arange(256) & 0xC0) == 0x80


STOPS = np.zeros(256, dtype=bool)
STOPS[list(b".!?")] = True


def units(data: np.ndarray, offs: np.ndarray, min_words: int):
    """Of each sentence of min_words: its text's index, its number among the text's sentences, two digests, start and end in bytes."""
    owner, number, w0, w1, starts, ends, hashes, _ = sentences(data, offs)
    at = np.flatnonzero(w1 - w0 >= min_words)
    again = text.hash_spans(text.LOWER[data], starts, ends, SECOND)
    one, two = (text.hash_runs(h, w0, seed).view(np.int64)[at] for h, seed in ((hashes, 0), (again, SECOND)))
    return owner[at], number[at], one, two, starts[w0[at]], ends[w1[at] - 1]


def sentences(data: np.ndarray, offs: np.ndarray):
    """All sentences: text, number in it, first word and past the last; all words' starts, ends and hashes; the sentence's line."""
    starts, ends, _ = text.word_spans(data, offs)
    hashes = text.hash_spans(text.LOWER[data], starts, ends)
    lo, _, lines = text.line_spans(data, offs)
    line = np.searchsorted(lo, starts, side="right") - 1  # of each word
    close = STOPS[data[ends - 1]] if ends.size else np.zeros(0, bool)
    close[:-1] |= line[1:] != line[:-1]
    if close.size:
        close[-1] = True
    w1 = np.flatnonzero(close) + 1
    w0 = np.concatenate([[0], w1[:-1]]).astype(np.int64) if w1.size else w1
    line = line[w0]
    owner = np.searchsorted(lines, line, side="right") - 1
    number = np.arange(w0.size) - np.searchsorted(owner, owner)
    return owner, number, w0, w1, starts, ends, hashes, line


def dedup(docs: DataFrame, min_words: int = 4) -> DataFrame:
    """docs with the text that is left, and n_units, n_removed, chars_removed (long) and removed (spans) beside it."""
    row_key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_at"), F.xxhash64("text").alias("_as")]

    def found(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offs = text.of_column(batch.column("text"))
        parts = []
        for a, _, d, o in text.slices(data, offs):
            owner, number, one, two, _, _ = units(d, o, min_words)
            parts.append((owner + a, number, one, two))
        owner, number, one, two = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows = pa.array(owner)
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), batch.column("_at").take(rows), batch.column("_as").take(rows), pa.array(number)], ["_one", "_two", "_at", "_as", "_line"])

    lines = frames.scan(docs.select(*row_key, F.col("text").cast("string").alias("text")), found, "_one long, _two long, _at long, _as long, _line long")
    place = F.struct("_at", "_as", "_line")
    ranked = lines.groupBy("_one", "_two").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least <> most")
    gone = lines.join(ranked.select("_one", "_two", "least"), ["_one", "_two"]).where(place != F.col("least"))
    gone = gone.groupBy("_at", "_as").agg(F.sort_array(F.collect_set("_line")).alias("_gone"))

    names = [c for c in docs.columns if c != "text"]
    plain = [f"_c{i}" for i in range(len(names))]
    marked = docs.select(*[F.col(f"`{n}`").alias(p) for n, p in zip(names, plain, strict=True)], F.col("text").cast("string").alias("text"), *row_key).join(gone, ["_at", "_as"], "left")
    out = "text string, n_units long, n_removed long, chars_removed long, removed array<struct<start:long,end:long>>"
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text.of_column(batch.column("text"))
        gone, absent = batch.column("_gone").to_pylist(), batch.column("text").is_null().to_pylist()
        texts, counts = [], []
        for a, b, d, o in text.slices(data, offs):
            owner, number, w0, w1, starts, ends, _, line = sentences(d, o)
            first, _, lines = text.line_spans(d, o)
            raw = d.tobytes()
            points = np.zeros(d.size + 1, np.int64)
            np.cumsum(~CONTINUES[d], out=points[1:])
            bounds = np.searchsorted(owner, np.arange(b - a + 1))
            counted = w1 - w0 >= min_words
            for i in range(b - a):
                here, drop = slice(bounds[i], bounds[i + 1]), gone[a + i]
                n = int(counted[here].sum())
                if not drop:
                    texts.append(None if absent[a + i] else raw[o[i] : o[i + 1]].decode())
                    counts.append((n, 0, 0, []))
                    continue
                hit = np.isin(number[here], drop)
                begin, stop = starts[w0[here]], ends[w1[here] - 1]
                spans = np.stack([points[begin[hit]], points[stop[hit]]], axis=1) - points[o[i]]
                counts.append((n, int(hit.sum()), int((spans[:, 1] - spans[:, 0]).sum()), [{"start": int(s), "end": int(e)} for s, e in spans]))
                # Parts of a line: from a sentence's first word (the first from the line's start) to the next one's.
                kept, at, mine = [], 0, line[here]
                for k in range(lines[i], lines[i + 1]):
                    end = int(first[k + 1]) - 1 if k + 1 < lines[i + 1] else int(o[i + 1])
                    to = at + int(np.searchsorted(mine[at:], k, side="right"))
                    if to == at or not hit[at:to].any():
                        kept.append(raw[first[k] : end])
                    elif not hit[at:to].all():
                        edges = [int(first[k]), *begin[at + 1 : to].tolist(), end]
                        kept.append(b"".join(raw[x:y] for x, y, h in zip(edges[:-1], edges[1:], hit[at:to], strict=True) if not h))
                    at = to
                texts.append(b"\n".join(kept).decode())
        n_units, n_removed, chars, spans = zip(*counts, strict=True)
        made = [pa.array(texts, pa.string()), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(chars, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        return pa.RecordBatch.from_arrays([*[batch.column(p) for p in plain], *made], [*plain, "text", "n_units", "n_removed", "chars_removed", "removed"])

    cleaned = frames.scan(marked.drop("_at", "_as"), cut, ", ".join([*[f"{p} {kinds[n]}" for n, p in zip(names, plain, strict=True)], out]))
    added = ["n_units", "n_removed", "chars_removed", "removed"]
    keep = [(p, n) for p, n in zip(plain, names, strict=True) if n not in added]
    return cleaned.select(*[F.col(p).alias(n) for p, n in keep], "text", *added)


#: The same by DuckDB, digest columns of the query.
ORACLE = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as number from docs),
cut as (
  select *, regexp_extract_all(line, '(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09-\x0D]+)*[\x20\x09-\x0D]*[^\x20\x09-\x0D]*[.!?](?:[\x20\x09-\x0D]+|$)|.+') as parts from lines
), units as (
  select *, array_to_string(regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') as norm,
    len(regexp_extract_all(part, '[^\x20\x09-\x0D]+')) as words
  from (select r, doc_id, number, unnest(parts) as part, generate_subscripts(parts, 1) as place from cut where len(parts) > 0)
), ranked as (
  select *, case when words >= 4 then row_number() over (partition by words >= 4, norm order by doc_id, number, place) else 1 end as nth from units
), line_sums as (
  select r, number, count(*) filter (words >= 4) as n_units, count(*) filter (nth > 1) as n_removed,
    coalesce(sum(length(regexp_replace(part, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'))) filter (nth > 1), 0) as chars,
    coalesce(string_agg(part, '' order by place) filter (nth = 1), '') as left_, count(*) filter (words > 0) = count(*) filter (nth > 1) and count(*) filter (nth > 1) > 0 as dropped
  from ranked group by r, number
)
select l.doc_id, sum(coalesce(s.n_units, 0))::bigint as n_units, sum(coalesce(s.n_removed, 0))::bigint as n_removed, sum(coalesce(s.chars, 0))::bigint as chars_removed,
  sha256(coalesce(string_agg(coalesce(s.left_, l.line), chr(10) order by l.number) filter (not coalesce(s.dropped, false)), '')) as kept_sha256
from lines l left join line_sums s using (r, number) group by l.r, l.doc_id
"""
