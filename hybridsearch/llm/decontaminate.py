"""Benchmark decontamination: BM25 retrieval of test items for every training passage, then overlap checks.

Test items are the indexed documents.  A text is cut into overlapping passages, long enough that any item lies
whole in one, and each passage is a query.  Items are indexed in blocks, each with its terms' postings and
largest weights and its lowest threshold ("block-max").  The short lists of rare terms are summed for all passages
of a batch at once; a passage goes on to those blocks only where an item's rare terms in it, and all the item's others,
could reach the item's threshold.  There WAND moves over the postings and scores only items whose terms' bounds
reach the block's.

An item without rare terms enough could be anywhere by that rule.  Such an item has keys instead: a passage with ``SIMILARITY``
of its n shingles lacks at most the rest, so it has one of any set of one more; the key set is of those shingles that fewest
items of the index have, and only passages with a key go on to the item's block.

An item's threshold is not a tuning knob.  A passage with ``SIMILARITY`` of the item's five-word shingles lacks at
most the other shingles' number of words, so its score is at least the item's full score less that many of its
largest term weights; everything at or above this is retrieved, and the shingles of the whole item, its question
part and its answer part are compared.  An item is found if the whole reaches ``SIMILARITY``.  Items have no answer of
their own, so the parts' overlaps are reported only: one changed word can leave a short answer part without any shingle.

The benchmark is read in portions of bounded size, each an index and a pass over the texts.  Document frequencies and
the mean length are those of the whole benchmark, so that scores do not depend on how it is divided.

Cases: null or empty texts and items match nothing (an item without words is left out); a text of any length is searched whole; an item
of fewer than five words is one shingle, without an answer part; repeated items and rows each give their own pairs; of passages that
hold as much of an item the first is reported; null ids are passed on; empty tables give no rows; other columns, whatever their names,
are ignored (``clean`` passes them on).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NOT_ALNUM, Words, shingles, slices

K1, B = 1.5, 0.75
WIDTH, SIMILARITY = 5, 0.8
#: Words of an item that come before its answer part.
QUESTION_SHARE = 2 / 3
#: Bytes of item texts in one index, which is sent to every task; a larger benchmark takes one pass of the documents a portion.
PORTION_BYTES = 8 << 20
#: Blocks of items in an index, and the most items that a rare word is in.
BLOCKS, RARE = 64, 8
_END = 1 << 60


@dataclass
class Index:
    """BM25 weights of a portion of the benchmark, in postings by block."""

    ids: list
    vocabulary: np.ndarray  # sorted word hashes
    stride: int
    threshold: np.ndarray  # by item
    low: np.ndarray  # lowest threshold by block
    rare: tuple  # postings of rare words: (first by word, items, weights)
    rest: np.ndarray  # by item: the sum of its other words' weights
    postings: list = field(repr=False)  # by block: word -> ([item], [weight], largest)
    whole: list = field(repr=False)  # by item: shingles
    question: list = field(repr=False)
    answer: list = field(repr=False)
    width: list = field(repr=False)  # words in a shingle: five, or all if there are fewer
    keys: dict = field(repr=False)  # by width: (sorted shingles, block of each) of items without rare words enough

    @staticmethod
    def build(ids: list, texts: list[str], similarity: float, corpus: Corpus) -> Index | None:
        own = _item_words(texts)
        ids, own = [i for i, w in zip(ids, own, strict=True) if len(w)], [w for w in own if len(w)]
        if not own:
            return None
        n, mean = len(own), corpus.mean
        vocabulary = np.unique(np.concatenate(own))
        counted = [np.unique(np.searchsorted(vocabulary, w), return_counts=True) for w in own]
        seen = np.bincount(np.concatenate([t for t, _ in counted]), minlength=len(vocabulary))
        df = corpus.frequency[np.searchsorted(corpus.vocabulary, vocabulary)]
        idf = np.log1p((corpus.n - df + 0.5) / (df + 0.5))
        size = -(-n // BLOCKS)
        triples, rest = [], np.zeros(n)
        postings: list = [defaultdict(lambda: ([], [])) for _ in range(BLOCKS)]
        threshold, parts = np.zeros(n), ([], [], [])
        for i, (w, (terms, tf)) in enumerate(zip(own, counted, strict=True)):
            weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            block = i // size
            seldom = seen[terms] <= RARE
            triples.append((terms[seldom], np.full(seldom.sum(), i), weight[seldom]))
            rest[i] = weight[~seldom].sum()
            for t, x in zip(terms.tolist(), weight.tolist(), strict=True):
                items, weights = postings[block][t]
                items.append(i)
                weights.append(x)
            width = min(WIDTH, len(w))
            sh = shingles(w, width)
            lacking = int((1 - similarity) * len(sh) + 1e-9)
            threshold[i] = (weight.sum() - np.sort(weight)[::-1][:lacking].sum()) * 0.999999
            first = max(1, min(len(sh), int(len(w) * QUESTION_SHARE)))
            for part, of in zip(parts, (sh, sh[:first], sh[first:]), strict=True):
                part.append(np.unique(of))
        keys = _keys(parts[0], [min(WIDTH, len(w)) for w in own], np.flatnonzero(rest >= threshold), size, similarity)
        low = np.array([threshold[k * size : (k + 1) * size].min() if k * size < n else np.inf for k in range(BLOCKS)])
        term, item, weight = (np.concatenate(x) for x in zip(*triples, strict=True))
        order = np.argsort(term, kind="stable")
        rare = (np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), item[order], weight[order])
        lists = [{t: (np.array(i), np.array(x), max(x)) for t, (i, x) in p.items()} for p in postings]
        return Index(ids, vocabulary, max(32, max(map(len, own))), threshold, low, rare, rest, lists, *parts, [min(WIDTH, len(w)) for w in own], keys)

    def wand(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """(item, score) of the block's items at or above their thresholds for a passage with these distinct terms."""
        index, low = self.postings[block], self.low[block]
        lists = [(*index[t], [0]) for t in terms.tolist() if t in index]
        out = []
        at = lambda x: int(x[0][x[3][0]]) if x[3][0] < len(x[0]) else _END
        while True:
            lists.sort(key=at)
            reach, pivot = 0.0, _END
            for x in lists:
                reach += x[2]
                if reach >= low:
                    pivot = at(x)
                    break
            if pivot == _END:
                return out
            if at(lists[0]) == pivot:
                score = 0.0
                for x in lists:
                    if at(x) != pivot:
                        break
                    score += float(x[1][x[3][0]])
                    x[3][0] += 1
                if score >= self.threshold[pivot]:
                    out.append((pivot, score))
            else:
                for x in lists:
                    if at(x) >= pivot:
                        break
                    x[3][0] = int(np.searchsorted(x[0], pivot))

    def _may_reach(self, half: np.ndarray, term: np.ndarray, next_too: np.ndarray) -> set[tuple[int, int]]:
        """(passage, block) where some item's rare words in the passage, and all its others, could reach its threshold."""
        first, items, weights = self.rare
        n = first[term + 1] - first[term]
        at = np.repeat(first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, weight, passage = items[at], weights[at], np.repeat(half, n)
        # a passage is a half and the next one of the same text
        also = (passage > 0) & next_too[passage - 1]
        n_items = len(self.threshold)
        key = np.concatenate([passage, passage[also] - 1]) * np.int64(n_items) + np.concatenate([item, item[also]])
        pair, inverse = np.unique(key, return_inverse=True)
        sums = np.bincount(inverse, np.concatenate([weight, weight[also]]), minlength=len(pair))
        i = pair % n_items
        close = sums + self.rest[i] >= self.threshold[i] * 0.999999
        size = -(-n_items // BLOCKS)
        return set(zip((pair[close] // n_items).tolist(), (i[close] // size).tolist(), strict=True))

    def _may_hold(self, words: Words, half: np.ndarray, next_too: np.ndarray) -> set[tuple[int, int]]:
        """(passage, block) where a key of an item without rare words enough stands."""
        found: set[tuple[int, int]] = set()
        for width, (known, blocks) in self.keys.items():
            here = shingles(words.hash, width)
            first, last = np.searchsorted(known, here), np.searchsorted(known, here, side="right")
            for at in np.flatnonzero(last > first).tolist():
                # a shingle lies in its first word's half and perhaps the next; the passage may begin a half before
                h, end = int(half[at]), int(half[at + width - 1])
                for b in set(blocks[first[at] : last[at]].tolist()):
                    found |= {(k, b) for k in range(max(0, h - 1), end + 1) if k == end or next_too[k]}
        return found

    def search(self, texts: pa.Array) -> dict[tuple[int, int], tuple]:
        """(row, item) -> (score, whole, question and answer overlap) of the best passage."""
        words = Words(texts, NOT_ALNUM)
        best: dict[tuple[int, int], tuple] = {}
        if not len(words):
            return best
        term = np.searchsorted(self.vocabulary, words.hash)
        known = term < len(self.vocabulary)
        known[known] = self.vocabulary[term[known]] == words.hash[known]
        # half passages, numbered over all texts
        piece = words.index // self.stride
        half = np.cumsum(np.concatenate([[0], (words.row[1:] != words.row[:-1]) | (piece[1:] != piece[:-1])]))
        n_terms = len(self.vocabulary)
        keys = np.unique(half[known] * np.int64(n_terms) + term[known])
        own, begin = np.unique(keys // n_terms, return_index=True)
        stop = np.append(begin[1:], len(keys))
        terms = keys % n_terms
        first = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]]))
        row = words.row[first]
        next_too = np.append(row[1:] == row[:-1], False)
        spans = {int(h): (int(a), int(b)) for h, a, b in zip(own, begin, stop, strict=True)}
        for h, block in sorted(self._may_reach(keys // n_terms, terms, next_too) | self._may_hold(words, half, next_too)):
            a, b = spans.get(h, (0, 0))
            c, d = spans.get(h + 1, (0, 0)) if next_too[h] else (0, 0)
            held = np.union1d(terms[a:b], terms[c:d])
            found = self.wand(held, block)
            if found:
                last = h + 1 if next_too[h] else h
                end = first[last + 1] if last + 1 < len(first) else len(words)
                inside = words.hash[first[h] : end]
                cache: dict[int, np.ndarray] = {}
                for item, score in found:
                    overlap = self._overlap(item, inside, cache)
                    if (key := (int(row[h]), item)) not in best or best[key][1] < overlap[0]:
                        best[key] = (score, *overlap)
        return best

    def _overlap(self, item: int, inside: np.ndarray, cache: dict[int, np.ndarray]) -> tuple:
        width = self.width[item]
        if width not in cache:
            cache[width] = np.unique(shingles(inside, width))
        share = lambda of: float(np.isin(of, cache[width]).mean()) if len(of) else None
        return share(self.whole[item]), share(self.question[item]), share(self.answer[item])


def _item_words(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, type=pa.string()), NOT_ALNUM)
    n_words = np.bincount(words.row, minlength=len(texts)) if len(words) else np.zeros(len(texts), int)
    return [words.hash[a : a + n] for a, n in zip(np.cumsum(n_words) - n_words, n_words, strict=True)]


def _keys(whole: list, width: list[int], free: np.ndarray, size: int, similarity: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width, keys of the ``free`` items: as many of their shingles that fewest items have as a passage cannot all lack."""
    out: dict[int, tuple[list, list]] = {}
    if not len(free):
        return {}
    values, counts = np.unique(np.concatenate(whole), return_counts=True)
    for i in free.tolist():
        own = whole[i]
        # a passage holds an item with so many of its distinct shingles at least
        enough = int(np.ceil(similarity * len(own) - 1e-9))
        rarest = np.argsort(counts[np.searchsorted(values, own)], kind="stable")[: len(own) - enough + 1]
        known, blocks = out.setdefault(width[i], ([], []))
        known.append(own[rarest])
        blocks.append(np.full(len(rarest), i // size))
    sort = lambda known, blocks: (known[order := np.argsort(known, kind="stable")], blocks[order])
    return {w: sort(np.concatenate(known), np.concatenate(blocks)) for w, (known, blocks) in out.items()}


@dataclass
class Corpus:
    """Statistics of the whole benchmark: items, mean length, and by word the items that have it."""

    n: int
    mean: float
    vocabulary: np.ndarray
    frequency: np.ndarray


def _portions(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of at most PORTION_BYTES (one item at least), read one after another."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        if texts and size + len(r["text"]) > PORTION_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
    if texts:
        yield ids, texts


def _statistics(benchmark: DataFrame) -> Corpus | None:
    """A vocabulary at most is held, of 16 bytes a word."""
    n = total = 0
    vocabulary, frequency = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    for _, texts in _portions(benchmark):
        words = [w for w in _item_words(texts) if len(w)]
        n, total = n + len(words), total + sum(map(len, words))
        new, counts = np.unique(np.concatenate([*map(np.unique, words), np.zeros(0, dtype=np.uint64)]), return_counts=True)
        vocabulary, inverse = np.unique(np.concatenate([vocabulary, new]), return_inverse=True)
        frequency = np.bincount(inverse, np.concatenate([frequency, counts]), minlength=len(vocabulary)).astype(np.int64)
    return Corpus(n, total / n, vocabulary, frequency) if n else None


def _indexes(benchmark: DataFrame, similarity: float) -> Iterator[Index]:
    corpus = _statistics(benchmark)
    for ids, texts in _portions(benchmark) if corpus else ():
        if index := Index.build(ids, texts, similarity, corpus):
            yield index


def _holds(overlap: tuple, similarity: float) -> bool:
    return overlap[1] >= similarity


PAIRS = "doc_id bigint, item_id bigint, score double, overlap double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for every document and benchmark item that it holds, with the best passage's BM25 score and overlaps."""
    out = None
    for index in _indexes(benchmark, similarity):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some, texts in slices(batch):
                    doc_ids = some.column("doc_id").to_pylist()
                    rows = [(doc_ids[r], index.ids[i], *x) for (r, i), x in index.search(texts).items() if _holds(x, similarity)]
                    if rows:
                        columns = zip(*rows, strict=True)
                        kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PAIRS)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], PAIRS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    for index in _indexes(benchmark, similarity):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some, texts in slices(batch):
                    keep = np.ones(some.num_rows, dtype=bool)
                    for (r, _), x in index.search(texts).items():
                        keep[r] &= not _holds(x, similarity)
                    yield some.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
