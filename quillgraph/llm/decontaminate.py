"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items.

Terms are pairs of neighbouring words: single words are shared by too many passages for any bound to tell them apart.
The index is inverted: a term's postings are its items in order, in blocks, each block with the greatest
contribution in it. Contributions are BM25 weights divided by the item's score of itself (of a long item, by the part of it that
any passage inside it can carry), so one threshold holds for all items. Block-max WAND retrieves all items at or above it:
terms are ordered by the item their cursor is at; the first term at which the sum of the lists' greatest contributions reaches
the threshold gives the pivot; the sum of the blocks' greatest contributions there decides whether the pivot is scored or
the cursors jump past the shallowest block. A passage in which no pivot can exist, because its terms'
greatest contributions together stay below the threshold, ends at that first test, which is done for all passages of a text at once.

Each retrieved item is verified: of the five-word shingles of its question (up to the first question mark or line end, or its first half)
and of its answer (the rest), at least ``overlap`` each must occur in the text around the passage; a half of fewer words is one shingle.
Items of two to four words have no five-word shingle: they leak where their words follow one another in a text, and items of one word only in
texts of that word, since a word by itself is ordinary use.

The index is flat arrays and covers at most ``WORDS_A_PASS`` words of items, a bound on what is broadcast (some forty bytes a word; one longer item is a pass of its own); more items take further
passes over the texts.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import in_pieces, table

K1, B = 1.2, 0.75
BLOCK = 8
PASSAGE_WORDS, STRIDE = 96, 48
THRESHOLD = 0.45
SHINGLE, OVERLAP = 5, 0.8
WORDS_A_PASS = 2_000_000

_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Lower-cased runs of characters, ASCII punctuation and white space taken as gaps."""
    return [] if text is None else text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()


def parts(text: str) -> tuple[list[bytes], list[bytes]]:
    """The question and the answer of an item."""
    cut = re.search(r"\?|\n", text)
    if cut and terms(text[: cut.end()]) and terms(text[cut.end() :]):
        return terms(text[: cut.end()]), terms(text[cut.end() :])
    w = terms(text)
    half = (len(w) + 1) // 2
    return w[:half], w[half:]


def _shingles(w: list[bytes], k: int = SHINGLE) -> set:
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


class Index:
    """``items``: (item id, text). Postings of the term ``t`` are ``docs[first[t]:first[t + 1]]``, their blocks' maxima ``block[low[t]:low[t + 1]]``."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self.threshold, self.overlap = threshold, overlap
        words = [(i, t, terms(t)) for i, t in items]
        known = [x for x in words if len(x[2]) >= SHINGLE]
        self.short: dict[bytes, list[int]] = {}
        for i, _, w in words:
            if 0 < len(w) < SHINGLE:
                self.short.setdefault(b" ".join(w), []).append(i)
        self.ids = [i for i, _, _ in known]
        self.words = list(dict.fromkeys(x for _, _, w in words for x in w))
        self.word = {x: k for k, x in enumerate(self.words)}
        self.base = len(self.word) + 1
        of = [np.fromiter(map(self.word.__getitem__, w), np.int64, len(w)) for _, _, w in known]
        self.text = [array("i", w.astype(np.int32).tobytes()) for w in of]
        self.question = [len(parts(t)[0]) for _, t, _ in known]
        self.size = size = np.array([len(w) for w in of], np.int64)

        pair = np.concatenate([w[:-1] * self.base + w[1:] for w in of]) if of else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(of)), np.maximum(size - 1, 0))
        order = np.lexsort((item, pair))
        pair, item = pair[order], item[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (item[1:] != item[:-1])
        at = np.flatnonzero(new)
        pair, item, f = pair[at], item[at], np.diff(np.append(at, len(new)))
        self.codes, first, seen = np.unique(pair, return_index=True, return_counts=True)
        seen = np.repeat(seen, seen)
        mean = size.mean() - 1 if len(size) else 1
        v = np.log(1 + (len(of) - seen + 0.5) / (seen + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * (size[item] - 1) / mean))
        v /= (np.bincount(item, v, minlength=len(of)) * np.minimum(1.0, (PASSAGE_WORDS - STRIDE) / np.maximum(size, 1)))[item]
        self.first = np.append(first, len(pair)).astype(np.int64)
        self.docs, self.weight = array("i", item.astype(np.int32).tobytes()), array("d", v.tobytes())
        many = -(-np.diff(self.first) // BLOCK)
        self.low = np.concatenate(([0], np.cumsum(many))).astype(np.int64)
        starts = np.repeat(self.first[:-1], many) + (np.arange(self.low[-1]) - np.repeat(self.low[:-1], many)) * BLOCK
        self.block = array("d", (np.maximum.reduceat(v, starts) if len(v) else v).tobytes())
        self.top = np.maximum.reduceat(v, self.first[:-1]) if len(v) else np.zeros(1)
        self.codes = self.codes if len(self.codes) else np.full(1, -1, np.int64)
        # the first two words of the short items that have two
        heads = {tuple(x.split()[:2]) for x in self.short if b" " in x}
        self.heads = np.array(sorted(self.word[a] * self.base + self.word[b] for a, b in heads), np.int64)

    def wand(self, query: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms ``query`` is at or above the threshold."""
        theta, found, docs = self.threshold - 1e-9, [], self.docs
        span = {t: (int(self.first[t]), int(self.first[t + 1]), int(self.low[t])) for t in query}
        top = {t: float(self.top[t]) for t in query}
        cursors = [[docs[span[t][0]], span[t][0], t] for t in query]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += top[t]
                if bound >= theta:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            blocks, end = 0.0, 1 << 60
            for doc, at, t in cursors[: pivot + 1]:
                a, z, low = span[t]
                at = at if doc == target else bisect_left(docs, target, at, z)
                if at < z:
                    b = (at - a) // BLOCK
                    blocks += self.block[low + b]
                    end = min(end, docs[min(z, a + (b + 1) * BLOCK) - 1] + 1)
            if pivot + 1 < len(cursors):
                end = min(end, cursors[pivot + 1][0])
            if blocks >= theta:
                total = 0.0
                for doc, at, t in cursors[: pivot + 1]:
                    at = at if doc == target else bisect_left(docs, target, at, span[t][1])
                    if at < span[t][1] and docs[at] == target:
                        total += self.weight[at]
                if total >= theta:
                    found.append((target, total))
                end = target + 1
            end = max(end, target + 1)
            for c in cursors[: pivot + 1]:
                z = span[c[2]][1]
                c[1] = bisect_left(docs, end, c[1], z)
                c[0] = docs[c[1]] if c[1] < z else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def _short(self, w: list[bytes], code: np.ndarray, at: np.ndarray) -> list[tuple[int, float, float, float, int]]:
        """Items of fewer than five words, each at its first place."""
        found: dict[int, int] = {}
        if len(w) == 1:
            found = dict.fromkeys(self.short.get(w[0], ()), 0)
        if len(self.heads) and len(code):
            near = np.minimum(np.searchsorted(self.heads, code), len(self.heads) - 1)
            for k in at[self.heads[near] == code].tolist():
                for n in (2, 3, 4):
                    if k + n <= len(w):
                        for i in self.short.get(b" ".join(w[k : k + n]), ()):
                            found.setdefault(i, k)
        return [(i, 1.0, 1.0, 1.0, k) for i, k in found.items()]

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """(item id, score, question overlap, answer overlap, word the best passage begins at), by item id."""
        w = terms(text)
        if not w or not self.words:
            return []
        ids = np.fromiter(map(self.word.get, w, repeat(-1)), np.int64, len(w))
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[at] * self.base + ids[at + 1]
        out = self._short(w, code, at) if self.short else []
        term = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = self.codes[term] == code
        at, term = at[known], term[known]
        total = np.concatenate(([0.0], np.cumsum(self.top[term])))
        theta = self.threshold - 1e-9
        if total[-1] < theta:
            return sorted(out)
        starts = np.arange(0, max(1, len(w) - (PASSAGE_WORDS - STRIDE)), STRIDE)
        low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + (PASSAGE_WORDS - 1))
        best: dict[int, tuple[float, int]] = {}
        for k in np.flatnonzero(total[high] - total[low] >= theta):
            for n, score in self.wand(np.unique(term[low[k] : high[k]]).tolist()):
                if score > best.get(n, (0.0, 0))[0]:
                    best[n] = (score, int(starts[k]))
        for n, (score, s) in best.items():
            size = int(self.size[n])
            near, item = w[max(0, s - size) : s + PASSAGE_WORDS + size], [self.words[k] for k in self.text[n]]
            q, a = (len(_shingles(h, k) & _shingles(near, k)) / len(_shingles(h, k)) for h in (item[: self.question[n]], item[self.question[n] :]) for k in [min(SHINGLE, len(h))])
            if q >= self.overlap and a >= self.overlap:
                out.append((self.ids[n], score, q, a, s))
        return sorted(out)


def indexes(items: DataFrame, words_a_pass: int = WORDS_A_PASS, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[Broadcast]:
    """Broadcast indexes that together cover all items with an id and a text, each of about ``words_a_pass`` words."""
    wanted = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    words = wanted.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    passes = -(-words // words_a_pass)
    for k in range(passes):
        mine = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        yield items.sparkSession.sparkContext.broadcast(Index(sorted((r["item_id"], r["text"]) for r in mine.collect()), threshold, overlap))


def scan(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, words_a_pass: int = WORDS_A_PASS) -> DataFrame:
    """(``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``, ``word``) of every leak.

    One row for each text and item that pass retrieval and verification. Null and empty texts, and items without
    words, leak nothing. An item id that is null is skipped. Repeated items give the leak once for each id and text; repeated
    documents give repeated rows, and a document without an id gives rows with a null one. Columns other than ``doc_id``, ``text``,
    ``item_id`` are ignored. Empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word int"
    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("word", pa.int32())])
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, words_a_pass, threshold, overlap):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for part in in_pieces(batches):
                rows = [(i, *leak) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for leak in index.value.leaks(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x.type) for k, x in enumerate(fields)], schema=fields)

        out = out.unionByName(given.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item leaks. Rows are judged one by one, by their own text; nulls and the rest as in ``scan``."""
    names = docs.columns
    for index in indexes(items):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            for batch in in_pieces(batches):
                yield batch.filter(pa.array([not index.value.leaks(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*names)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item whose question and answer both occur in the document. Nulls, empty texts, repeated rows, other
    columns and empty tables: as ``scan``.
    """
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
