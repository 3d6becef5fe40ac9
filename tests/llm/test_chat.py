import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from tests.llm import duck
from vesper.llm import chat, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, segment long"
ROWS = [
    (1, 0, "system", "be kind", 1), (1, 1, "user", None, 1), (1, 2, "assistant", "\n\n  spaced \U0001f600\U0001f469‍\U0001f680 é\n", 1), (1, 3, "assistant", "", 1),
    (1, 4, "assistant", "again", 1), (2, None, "assistant", "first", 1), (2, 0, None, "<|endoftext|> <\\s> <\\\\/s> [\\INST] <s", 1), (2, 0, "assistant", "</s>[INST] ok [/INST]<", 1),
    (None, 0, "assistant", "a", 1), (None, 0, "assistant", "a", 1), (3, 5, "[INST]", "x", 1), (4, 0, "user", "only", 1), (5, 1, "assistant", "s> INST]", 1), (5, 2, "assistant", "[", 1),
]


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    segments = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), PATH)
    return sorted((tuple(r)[:5] for r in chat.digests(segments).collect()), key=str)


def test_as_brute_force(spark):
    assert got(spark, ROWS) == brute(ROWS)
    assert got(spark, []) == []


def test_a_long_conversation_has_the_ids_of_one_encoding(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " + "word é " * 900, 0) for i in range(120)] + [(8, 0, "assistant", "x " * 300_000, 0)]
    assert got(spark, rows) == brute(rows)
    segments = [r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA), PATH).collect() if r.conv_id == 7]
    assert [r.segment for r in segments] == list(range(len(segments))) and len(segments) > 3
    whole = chat.marked_tokenizer(PATH).tokenizer.encode("".join(r.text for r in segments), add_special_tokens=False)
    assert [i for r in segments for i in r.ids] == whole.ids


@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<", "[", " ", "  ", "\n", "é", "ß", "Ǆ", "\U0001f600", "word", " It's", "42", "<|endoftext|>", "ÿ"]), max_size=20))
def test_ids_and_offsets_are_the_tokenizers(parts):
    encoder, said = chat.marked_tokenizer(PATH), "".join(parts)
    ids, starts, ends = encoder.encode(said)
    whole = encoder.tokenizer.encode(said, add_special_tokens=False)
    assert ids.tolist() == whole.ids
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == whole.offsets


@given(st.text(alphabet="<>[]/\\sINST|endoftx ab", max_size=40))
def test_escapes_are_reversible_and_leave_no_mark(said):
    body = chat.escaped(said)
    assert chat.unescaped(body) == said
    assert not any(m in body for m in (chat.BEGIN, chat.OPEN, chat.CLOSE, chat.END, chat.STOP))


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6)), max_size=8), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5)), max_size=12))
def test_binary_search_finds_the_overlaps(gaps, tokens):
    spans, at = [], 0
    for gap, size in gaps:
        spans.append((at + gap, at + gap + size + 1))
        at += gap + size + 1
    a, b = np.array([t for t, _ in tokens], dtype=int), np.array([t + n for t, n in tokens], dtype=int)
    found = chat.overlapping(a, b, np.array(spans, dtype=int).reshape(-1, 2))
    assert found.tolist() == [any(x < e and y > s and x < y for s, e in spans) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_as_sql(spark):
    assert duck.frame_rows(queries.op1_chat_formatting(spark, "/root/testdata/sf0.001")) == duck.rows(chat.ORACLE)
