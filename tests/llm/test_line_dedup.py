import re

from tests.llm import duck, hard
from vesper.llm import line_dedup, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def parts(line):
    """A line's sentences with the white space around them."""
    out = [""]
    for piece in re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+[\x20\x09-\x0d]*|[\x20\x09-\x0d]+", line):
        out[-1] += piece
        if WORD.search(piece) and WORD.search(piece)[0][-1] in ".!?":
            out.append("")
    return [x for x in out if x]


def brute(rows, least):
    seen, gone = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            for p, part in enumerate(parts(line)):
                words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), part))
                if len(words) >= least:
                    if " ".join(words) in seen:
                        gone.setdefault((d, t), set()).add((k, p))
                    seen.setdefault(" ".join(words), (d, k))
    out = []
    for d, t in rows:
        drop, kept, cut = gone.get((d, t), set()), [], []
        for k, line in enumerate((t or "").split("\n")):
            left = [x for p, x in enumerate(parts(line)) if (k, p) not in drop]
            cut += [x.strip(" \t\n\r\x0b\x0c") for p, x in enumerate(parts(line)) if (k, p) in drop]
            if any(WORD.search(x) for x in left) or not any(q == k for q, _ in drop):
                kept.append("".join(left))
        out.append((d, t if not drop else "\n".join(kept), tuple(cut)))
    return sorted(out, key=str)


SAID = "One two three four. A b c! Short. Five six seven eight nine?"
PASSAGES = [(1, SAID), (2, f"Host words here {SAID} and then more of it.\n  {SAID}  "), (3, f"{SAID}\n{SAID}\n\nIts own line stays here.  One two three four."), (4, "one TWO three\tfour. end"), (5, " \n \n"), (6, f"{SAID} tail")]


def test_as_brute_force(spark):
    for docs, least in ((hard.documents(spark), 2), (hard.sample(spark), 4), (spark.createDataFrame(PASSAGES, 'doc_id long, text string'), 3)):
        done = line_dedup.dedup(docs, least)
        assert [c for c in docs.columns if c != "text"] == [c for c in done.columns if c not in ("text", "n_units", "n_removed", "chars_removed", "removed")]
        texts = dict(docs.select("doc_id", "text").collect())
        got = sorted(((r.doc_id, r.text, tuple(texts[r.doc_id][s.start : s.end] for s in r.removed)) for r in done.select("doc_id", "text", "removed").collect()), key=str)
        assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], least)


def test_as_sql(spark):
    assert duck.frame_rows(queries.op10_substring_dedup(spark, "/root/testdata/sf0.001")) == duck.rows(line_dedup.ORACLE)


def test_empty_table(spark):
    assert line_dedup.dedup(hard.empty(spark)).collect() == []
