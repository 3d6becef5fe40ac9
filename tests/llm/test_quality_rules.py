import re
from collections import Counter

from tests.llm import hard
from vesper.llm import quality_rules as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered.update(range(i, i + 8))
    lines, lost, out = [x for x in text.split("\n")], 0, []
    full = [x for x in lines if WORD.search(x)]
    for line in lines:
        w = WORD.findall(line)
        chars = sum(map(len, w))
        lone = sum(x in set("|></-*+") for x in w)
        bad = bool(w) and (
            not any(x[-1] in ".!?" for x in w)
            or 10 * sum(x.endswith("!!") for x in w) > 3 * len(w)
            or 10 * sum(c in "#*$%&|<>~^=_{}\\" for c in line) > chars
            or lone >= 2 and 5 * lone >= len(w)
            or any(p in re.sub("[A-Z]", lambda m: m[0].lower(), line) for p in map(bytes.decode, Q.BOILERPLATE))
        )
        lost += chars * bad
        out += [] if bad else [line]
    chars = sum(map(len, words))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    kept = not failed and 100 * lost <= 50 * chars
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(covered), failed, kept, "\n".join(out))


def got(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.clean_text) for r in Q.clean(df).collect()), key=str)


def test_as_brute_force(spark):
    for docs in (hard.documents(spark), hard.sample(spark)):
        assert got(docs) == sorted(((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)


def test_empty_table(spark):
    assert got(hard.empty(spark)) == []
