"""Exact top-k search by BM25: an inverted index per shard, block-max WAND for many documents at once, and an exact merge.

Queries are rows, each as all words of its whole text that a document has; ``terms``, if given, keeps those
of the highest BM25 weight only (as more-like-this queries are made). They run in blocks of at most
BLOCK_QUERIES rows and BLOCK_TERMS words, so what tasks are sent has that bound; each block reads all documents three times:

1. each task counts the documents that have the block's words; sums are the global statistics (number of documents, mean length,
   document frequencies), and the queries' words are chosen by them;
2. one document in SAMPLE, in as large a part of the tasks (SAMPLE_TASKS at least), is searched as in step 3: what the
   k-th best of these scores is a bound from below for each query, however many tasks there are;
3. each task indexes its own documents, SHARD postings at a time: postings of the chosen words with their scores. Block-max WAND
   gives a shard's k best of at least the bound: documents that only lists with too small maxima hold are never looked at,
   those that the maxima of blocks rule out aren't scored (``Shard.searches``, for TOGETHER queries at a time; ``wand`` is the same
   one document at a time, for comparison). The k best of these are the answer, as all shards score with the same statistics.

A bound prunes only what is strictly below the k-th score, so ties are all seen; they go to the lesser doc_id.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, as 64-bit hashes. Defined results: null or empty texts match
nothing and count as documents of length 0; queries without a word that a document has give no rows; rows of one doc_id are one query
(the least text) but each a hit; documents without a doc_id are found, last among ties; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import frames, text

K1, B = 1.2, 0.75
BLOCK_QUERIES, BLOCK_TERMS = 65_536, 10_000_000
POSTINGS = 64
#: Postings indexed at once in a task.
SHARD = 4_000_000
#: Neighbouring documents with a common maximum of a list, for long lists: those that one document in LONG is in, the longest
#: LISTS at most, with CELLS places of documents together. The others are added up posting by posting.
NEXT_TO, LONG, LISTS, CELLS = 16, 20, 4096, 1 << 23
#: Queries that are searched together at most, and the sums of theirs that are held.
TOGETHER, HELD = 256, 1 << 21
#: Lists are put off while their maxima add up to less than this part of the k-th score.
PUT_OFF = 0.25
#: The first search is of one document in so many, in so many tasks at least.
SAMPLE, SAMPLE_TASKS = 8, 8
LAST = (1 << 63) - 1
#: Digits after the point that scores are compared by; of equal ones the lesser doc_id comes first.
DIGITS = 9
DONE = np.iinfo(np.int64).max


def term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each text's first word."""
    starts, ends, first = text.word_spans(data, offs)
    return text.hash_spans(text.LOWER[data], starts, ends), first


class Lookup:
    """Places of hashes in a sorted array; -1 for others. A table of 2**22 bits tells most of them at once."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(terms >> np.uint64(42)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.size, -1, dtype=np.int64)
        if self.terms.size and hashes.size:
            at = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.terms, hashes[at]), self.terms.size - 1)
            hit = self.terms[place] == hashes[at]
            out[at[hit]] = place[hit]
        return out


def counts(data: np.ndarray, offs: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, text, times) of the looked-up words, each pair once, and the texts' lengths in words."""
    hashes, first = term_hashes(data, offs)
    found = lookup.find(hashes)
    at = np.flatnonzero(found >= 0)
    owner = np.searchsorted(first, at, side="right") - 1
    pair, times = np.unique((owner << 32) | found[at], return_counts=True)
    return pair & 0xFFFFFFFF, pair >> 32, times, np.diff(first)


class Cursor:
    """A term's postings: documents in order, their scores, and the greatest score of each block and of all."""

    __slots__ = ("at", "best", "blocks", "docs", "now", "scores")

    def __init__(self, docs: np.ndarray, scores: np.ndarray):
        self.docs, self.scores, self.at = docs, scores, 0
        self.blocks = np.maximum.reduceat(scores, np.arange(0, scores.size, POSTINGS))
        self.best = float(self.blocks.max())
        self.now = int(docs[0])

    def seek(self, doc: int) -> None:
        """To the first posting at or after doc."""
        self.at += int(np.searchsorted(self.docs[self.at :], doc))
        self.now = int(self.docs[self.at]) if self.at < self.docs.size else DONE

    def block(self, doc: int) -> tuple[float, int]:
        """The greatest score of the block that doc would be in, and that block's last document."""
        at = self.at + int(np.searchsorted(self.docs[self.at :], doc))
        if at >= self.docs.size:
            return 0.0, DONE - 1
        b = at // POSTINGS
        return float(self.blocks[b]), int(self.docs[min((b + 1) * POSTINGS, self.docs.size) - 1])


def wand(lists: list[tuple[np.ndarray, np.ndarray]], k: int, ids: np.ndarray) -> list[tuple[float, int]]:
    """The k best (score, document) by block-max WAND over a shard's postings; ties go to the lesser id."""
    cursors = [Cursor(d, s) for d, s in lists if d.size]
    heap: list[tuple[float, int, int]] = []  # score, minus id, document: the worst first
    while cursors:
        cursors = sorted((c for c in cursors if c.now != DONE), key=lambda c: c.now)
        limit = heap[0][0] if len(heap) == k else -1.0
        slack = limit - 1e-8 * max(1.0, abs(limit))  # scores are compared when rounded to nine digits
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c.best
            if total >= slack:
                pivot = i
                break
        if pivot < 0:
            break
        doc = cursors[pivot].now
        while pivot + 1 < len(cursors) and cursors[pivot + 1].now == doc:
            pivot += 1
        blocks = [c.block(doc) for c in cursors[: pivot + 1]]
        if sum(b for b, _ in blocks) < slack:  # no document up to the nearest block end can do
            after = min(e for _, e in blocks) + 1
            if pivot + 1 < len(cursors):
                after = min(after, cursors[pivot + 1].now)
            for c in cursors[: pivot + 1]:
                if c.now < after:
                    c.seek(after)
        elif cursors[0].now == doc:
            score = 0.0
            for c in cursors[: pivot + 1]:
                score += float(c.scores[c.at])
                c.seek(doc + 1)
            entry = (round(score, DIGITS), -int(ids[doc]), doc)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        else:
            for c in cursors[:pivot]:
                if c.now < doc:
                    c.seek(doc)
    return [(s, d) for s, _, d in sorted(heap, reverse=True)]


class Shard:
    """A shard's postings by term and by document, with the greatest score of each list, and of its blocks of documents for long lists."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: np.ndarray, terms: int):
        """Postings in the order (doc, term)."""
        n, self.ids = ids.size, ids
        self.term, self.score = term, score
        self.first = np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        by_term = term[order]
        self.docs, self.scores = doc[order].astype(np.int32), (score[order] * (1 + 1e-7)).astype(np.float32)  # rounded up
        self.bounds = np.searchsorted(by_term, np.arange(terms + 1))
        self.size = np.diff(self.bounds)
        self.best, there = np.zeros(terms), np.flatnonzero(self.size)
        if there.size:
            self.best[there] = np.maximum.reduceat(self.scores, self.bounds[there])
        long = np.flatnonzero(self.size >= max(n / LONG, 2))
        if long.size > (most := min(LISTS, CELLS // max(n, 1))):
            long = np.sort(long[np.argsort(-self.size[long], kind="stable")[:most]])
        self.row = np.full(terms, -1, dtype=np.int64)
        self.row[long] = np.arange(long.size)
        some = np.flatnonzero(self.row[by_term] >= 0)
        self.cells = np.zeros((long.size, n), dtype=np.float32)
        self.cells[self.row[by_term[some]], self.docs[some]] = self.scores[some]
        self.blocks = np.maximum.reduceat(self.cells, np.arange(0, n, NEXT_TO), axis=1) if n else self.cells
        #: Sums of cells differ from those of scores by less than this factor.
        self.loose = 1 + (long.size + 16) * 2.0**-23
        self.asked = np.zeros(terms, dtype=bool)

    def add(self, total: np.ndarray, own: np.ndarray) -> np.ndarray:
        """total and all postings of the lists."""
        if not own.size:
            return total
        at = _ranges(self.bounds[own], self.size[own])
        return total + np.bincount(self.docs[at], self.scores[at], self.ids.size)

    def exact(self, docs: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Scores of the documents, added up in the order of terms: equal texts get equal scores in every shard."""
        self.asked[own] = True
        edges = list(zip(self.first[docs].tolist(), self.first[docs + 1].tolist(), strict=True))
        hit = np.flatnonzero(self.asked[np.concatenate([self.term[a:b] for a, b in edges])])
        self.asked[own] = False
        score = np.concatenate([self.score[a:b] for a, b in edges])[hit]
        owner = np.searchsorted(np.cumsum([b - a for a, b in edges]), hit, side="right")
        return np.round(np.bincount(owner, score, docs.size), DIGITS)

    def search(self, own: np.ndarray, k: int, least: float = 0.0) -> list[tuple[float, int]]:
        """``searches`` for one query."""
        return next(self.searches([own], k, [least]))

    def searches(self, asked: list[np.ndarray], k: int, least: list[float]) -> Iterator[list[tuple[float, int]]]:
        """For each query what ``wand`` gives, of the scores of at least ``least``; bounds are put to all documents at once instead of one after the other.

        Pivots: lists whose maxima add up to less than a part of the k-th score are put off, as no document is a pivot by
        them alone; the others' postings are added up, those of long lists for many queries by one product of matrices. Blocks: a document
        whose sum and the put-off lists' maxima in its block, then in itself, don't reach the k-th score is ruled out. Only what
        is left is scored.
        """
        step = max(1, min(TOGETHER, HELD // max(self.ids.size, 1)))
        for a in range(0, len(asked), step):
            some = [own[self.size[own] > 0] for own in asked[a : a + step]]
            taken, put_off = (np.zeros((len(some), len(self.cells)), dtype=np.float32) for _ in range(2))
            off = []
            for i, own in enumerate(some):
                long = own[self.row[own] >= 0]
                long = long[np.argsort(self.best[long], kind="stable")]
                n = int(np.searchsorted(np.cumsum(self.best[long]), PUT_OFF * least[a + i]))
                off.append(self.row[long[:n]])
                put_off[i, off[-1]], taken[i, self.row[long[n:]]] = 1, 1
            parts, blocks = taken @ self.cells, put_off @ self.blocks
            for i, own in enumerate(some):
                yield self._best(own, off[i], parts[i], blocks[i], k, float(least[a + i]))

    def _best(self, own: np.ndarray, off: np.ndarray, part: np.ndarray, blocks: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        part = self.add(part, own[self.row[own] < 0])
        floor = least or _kth(part, k) / self.loose  # what k documents have by a part of the lists is a bound, too
        bound = part + np.repeat(blocks, NEXT_TO)[: part.size] if off.size else part
        at = np.flatnonzero(bound >= max(_under(floor) / self.loose, 1e-30))
        if at.size > 2 * k:
            floor = max(floor, _kth(part[at], k) / self.loose)
            at = at[bound[at] >= _under(floor) / self.loose]
        if off.size and at.size:  # the put-off lists' own scores instead of their blocks'
            bound = part[at] + self.cells[np.ix_(off, at)].sum(axis=0, dtype=np.float64)
            floor = max(floor, _kth(bound, k) / self.loose)
            at = at[bound >= _under(floor) / self.loose]
        if not at.size:
            return []
        score = self.exact(at, own)
        best = np.lexsort((at, self.ids[at], -score))[:k]
        best = best[score[best] >= round(floor, DIGITS) - 1e-8] if floor else best
        return list(zip(score[best].tolist(), at[best].tolist(), strict=True))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)


def _kth(scores: np.ndarray | float, k: int) -> float:
    """The k-th greatest, 0 if there are fewer."""
    if not isinstance(scores, np.ndarray) or scores.size < k:
        return 0.0
    return float(np.partition(scores, scores.size - k)[scores.size - k])


def _under(score: float) -> float:
    """What is still compared with a score when both are rounded."""
    return score - 1e-8 * max(1.0, abs(score))


def sums(lists: list[tuple[np.ndarray, np.ndarray]], k: int, ids: np.ndarray, least: float = 0.0) -> list[tuple[float, int]]:
    """``Shard.search`` for lists of their own."""
    term = np.repeat(np.arange(len(lists)), [d.size for d, _ in lists])
    doc, score = (np.concatenate(x) for x in zip(*lists, strict=True))
    order = np.lexsort((term, doc))
    return Shard(term[order], doc[order], score[order], ids, len(lists)).search(np.arange(len(lists)), k, least)


def idf(n: float, df: np.ndarray) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def _frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        df, rows, words = np.zeros(lookup.terms.size, dtype=np.int64), 0, 0
        for batch in batches:
            data, offs = text.of_column(batch.column("text"))
            for _, _, d, o in text.slices(data, offs):
                term, _, _, length = counts(d, o, lookup)
                df += np.bincount(term, minlength=df.size)
                words += int(length.sum())
            rows += batch.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [rows, words]]))], ["term", "n"])

    return run


def _search(shared, first, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, query_ids, query_bounds, query_terms, mean = shared.value
        seeds = first.value if first else np.zeros(len(query_ids))
        lookup = Lookup(terms)
        best: list[list[tuple[float, int]]] = [[] for _ in query_ids]  # (minus score, id), the best first
        parts, ids, lengths, base, size = [], [], [], 0, 0

        def shard() -> None:
            own_ids, length = np.concatenate(ids), np.concatenate(lengths)
            term, doc, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            score = weight[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * length[doc] / max(mean, 1e-9)))
            index = Shard(term, doc, score, own_ids, terms.size)
            asked = [query_terms[x:y] for x, y in zip(query_bounds[:-1].tolist(), query_bounds[1:].tolist(), strict=True)]
            least = [max(float(s), -b[-1][0] if len(b) == k else 0.0) for s, b in zip(seeds, best, strict=True)]
            for q, hits in enumerate(index.searches(asked, k, least)):
                if hits:
                    best[q] = sorted(best[q] + [(-s, int(own_ids[d])) for s, d in hits])[:k]

        for batch in batches:
            data, offs = text.of_column(batch.column("text"))
            at = batch.column("at").to_numpy()
            for a, b, d, o in text.slices(data, offs):
                term, doc, times, length = counts(d, o, lookup)
                parts.append((term.astype(np.int32), (doc + base).astype(np.int32), times.astype(np.int32)))
                ids.append(at[a:b])
                lengths.append(length)
                base, size = base + b - a, size + term.size
                if size >= SHARD:
                    shard()
                    parts, ids, lengths, base, size = [], [], [], 0, 0
        if base:
            shard()
        out = [(int(q), d, -s) for q, hits in zip(query_ids, best, strict=True) for s, d in hits]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "doc_id", "score"])

    return run


def _query_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = text.of_column(batch.column("text"))
    words, times = [], []
    for _, _, d, o in text.slices(data, offs):
        hashes, first = term_hashes(d, o)
        for a, b in zip(first[:-1], first[1:], strict=True):
            w, n = np.unique(hashes[a:b], return_counts=True)
            words.append(w.view(np.int64))
            times.append(n)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "words", "times"])


def _blocks(rows) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    block, size = [], 0
    for r in rows:
        if block and (len(block) == BLOCK_QUERIES or size + len(r.words) > BLOCK_TERMS):
            yield block
            block, size = [], 0
        block.append((r.doc_id, np.array(r.words, dtype=np.int64).view(np.uint64), np.array(r.times, dtype=np.int32)))
        size += len(r.words)
    if block:
        yield block


def first_tasks(rows: DataFrame) -> int:
    """Tasks of the first search: each has about as many documents as one of the second."""
    return max(SAMPLE_TASKS, -(-rows.rdd.getNumPartitions() // SAMPLE))


def search(docs: DataFrame, queries: DataFrame, k: int = 10, terms: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best of docs for each row of queries (doc_id, text), by all its words or its ``terms`` best."""
    spark = docs.sparkSession
    rows = frames.doc_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LAST)).alias("at"), "text")
    asked = frames.doc_columns(queries, "doc_id", "text").where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    asked = frames.keep(frames.scan(asked, _query_words, "doc_id long, words array<long>, times array<long>"), "queries")
    found = []
    for block in _blocks(asked.toLocalIterator()):
        wanted = np.unique(np.concatenate([w for _, w, _ in block]))
        shared = spark.sparkContext.broadcast(wanted)
        sums = rows.select("text").mapInArrow(_frequencies(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        place, n = sums["term"].to_numpy(dtype=np.int64), sums["n"].to_numpy(dtype=np.int64)
        total, words = int(n[place == -1].sum()), int(n[place == -2].sum())
        df = np.zeros(wanted.size, dtype=np.int64)
        df[place[place >= 0]] = n[place >= 0]
        weight = idf(total, df)
        chosen = []
        for _, w, times in block:
            at = np.searchsorted(wanted, w)
            worth = np.where(df[at] > 0, weight[at] * times * (K1 + 1) / (times + K1), -1)
            best = np.lexsort((w, -worth))[:terms]
            chosen.append(at[best][worth[best] > 0])
        used = np.unique(np.concatenate(chosen)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum([c.size for c in chosen])])
        plan = (wanted[used], weight[used], np.array([q for q, _, _ in block]), bounds, np.searchsorted(used, np.concatenate(chosen)).astype(np.int32), words / max(total, 1))
        plan, schema = spark.sparkContext.broadcast(plan), "query_id long, doc_id long, score double"
        some = rows.where(F.pmod(F.xxhash64("at"), F.lit(SAMPLE)) == 0).repartition(first_tasks(rows)).mapInArrow(_search(plan, None, k), schema)
        kth = some.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("score")).where("score is not null").toPandas()
        kth = dict(zip(kth["query_id"].tolist(), kth["score"].tolist(), strict=True))
        seeds = spark.sparkContext.broadcast(np.array([kth.get(q, 0.0) for q, _, _ in block]))
        found.append(frames.keep(rows.mapInArrow(_search(plan, seeds, k), schema), "hits"))
        for sent in (shared, plan, seeds):
            sent.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score")
