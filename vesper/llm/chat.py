"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by a template, encoded once with character offsets, and its sorted turn spans are
intersected with the token spans by binary search: a token has loss if it overlaps the text of a turn whose role
is in ``learned``.

The template is ``<s>role[INST]text[/INST]</s>`` per turn. Its four marks are special tokens of the tokenizer that
is used, so no token straddles the end of a text. Inside roles and texts, control strings (the marks and the vocabulary's own
end mark) get a backslash after their first sign, and those that have backslashes there already one more;
``unescaped`` takes it out again, so everything can be read back.

One exchange deals rows by conversation; each task streams its rows in the order (conv_id, turn, role, text). A
conversation of over SEGMENT_CHARS goes on in further segments, cut between turns, where the marks keep
encodings apart; so even a conversation with a third of all rows is held only a segment at a time.

Defined results: null roles and texts are empty; null turns come first; equal turns are ordered by role and text;
rows without conv_id are one conversation; repeated rows are turns of their own; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

# The template's marks, and the vocabulary's end mark.
BEGIN, OPEN, CLOSE, END, STOP = "<s>", "[INST]", "[/INST]", "</s>", "<|endoftext|>"
ESCAPE = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\])|\|endoftext\|>)")
UNESCAPE = re.compile(r"([<\[])(\\*)\\(/?(?:s>|INST\])|\|endoftext\|>)")
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)
#: A segment is closed at the end of the turn that reaches this; segments are encoded some at a time.
SEGMENT_CHARS, BATCH_CHARS = 1 << 17, 1 << 20
SEGMENTS = "conv_id long, segment int, n_turns int, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escaped(said: str) -> str:
    return ESCAPE.sub(r"\1\2\\\3", said)


def unescaped(said: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", said)


def rendered(role: str, said: str) -> tuple[str, int, int]:
    """A turn by the template, and the span of its text in it."""
    head, body = f"{BEGIN}{escaped(role)}{OPEN}", escaped(said)
    return f"{head}{body}{CLOSE}{END}", len(head), len(head) + len(body)


def overlapping(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the token spans overlap one of the sorted, disjoint spans: a binary search for each token."""
    if not len(spans):
        return np.zeros(starts.size, dtype=bool)
    at = np.searchsorted(spans[:, 0], ends, side="left") - 1  # the last span that begins before the token ends
    return (at >= 0) & (spans[np.maximum(at, 0), 1] > starts) & (ends > starts)


def marked_tokenizer(path: str) -> tokens.MarkedEncoder:
    return tokens.marked_encoder(path, (BEGIN, OPEN, CLOSE, END))


def format_conversations(conversations: DataFrame, tokenizer: str, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The segments of all conversations, in order (see SEGMENTS): text, token ids, their offsets in it, and the loss mask."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = marked_tokenizer(tokenizer)
        ready: list[tuple] = []
        now, number, parts, spans, size = None, 0, [], [], 0
        begun = False

        def close():
            nonlocal parts, spans, size, number
            if parts:
                ready.append((now, number, len(parts), "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)))
                parts, spans, size, number = [], [], 0, number + 1

        def encoded():
            nonlocal ready
            said = [encoder.encode(r[3]) for r in ready]
            loss = [overlapping(starts, ends, r[4]) for r, (_, starts, ends) in zip(ready, said, strict=True)]
            bounds = np.zeros(len(ready) + 1, dtype=np.int32)
            np.cumsum([ids.size for ids, _, _ in said], out=bounds[1:])
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(x))) for x in (*zip(*said, strict=True), loss)]
            conv, segment, turns, texts = (pa.array([r[i] for r in ready], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string())))
            ready = []
            return pa.RecordBatch.from_arrays([conv, segment, turns, texts, *lists], [f.split()[0] for f in SEGMENTS.split(", ")])

        for batch in batches:
            for conv, role, said in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if not begun or conv != now:
                    close()
                    now, number, begun = conv, 0, True
                turn, a, b = rendered(role, said)
                if role in learned and b > a:
                    spans.append((size + a, size + b))
                parts.append(turn)
                size += len(turn)
                if size >= SEGMENT_CHARS:
                    close()
                if sum(len(r[3]) for r in ready[-1:]) and len(ready) >= 256 or size + sum(len(r[3]) for r in ready[-8:]) >= BATCH_CHARS and ready:
                    yield encoded()
        close()
        if ready:
            yield encoded()

    return rows.mapInArrow(run, SEGMENTS)


def masked(said: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The runs of text under a loss mask: what its tokens cover, each character once, tokens that touch joined."""
    a, b = starts[loss], np.maximum.accumulate(ends[loss])
    if not a.size:
        return []
    cuts = np.flatnonzero(a[1:] > b[:-1])
    return [said[i:j] for i, j in zip(a[np.r_[0, cuts + 1]].tolist(), b[np.r_[cuts, b.size - 1]].tolist(), strict=True)]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(segments: DataFrame) -> DataFrame:
    """A row per conversation, all of it read back from its segments as format_conversations makes them (see DIGESTS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        done: list[tuple] = []

        def closed():
            if now:
                done.append((now["conv"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"], now["tokens"], now["learned"]))

        def table():
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in DIGESTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [f.split()[0] for f in DIGESTS.split(", ")])

        for batch in batches:
            conv, segment, said = (batch.column(n).to_pylist() for n in ("conv_id", "segment", "text"))
            for i in range(batch.num_rows):
                if segment[i] == 0:
                    closed()
                    now = {"conv": conv[i], "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "tokens": 0, "learned": 0}
                for role, body in TURN.findall(said[i]):
                    now["turns"] += 1
                    now["all"].update(f"{unescaped(role)}\n{unescaped(body)}\n".encode())
                starts, ends, loss = (np.asarray(batch.column(n)[i].values) for n in ("starts", "ends", "loss"))
                for body in masked(said[i], starts, ends, loss):
                    body = unescaped(body)
                    now["chars"] += len(body)
                    now["loss"].update(body.encode())
                now["size"] += len(said[i])
                now["tokens"] += starts.size
                now["learned"] += int(loss.sum())
            if done:
                yield table()
                done = []
        closed()
        if done:
            yield table()

    return segments.mapInArrow(run, DIGESTS)


#: The same by DuckDB but for the counts of tokens.
ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *, regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\])|\|endoftext\|>)', '\1\2\\\3', 'g') as role_, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\])|\|endoftext\|>)', '\1\2\\\3', 'g') as text_ from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role_) + length(text_) + length('<s>[INST][/INST]</s>'))::bigint as formatted_chars
from marked group by conv_id
"""
