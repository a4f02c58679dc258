"""Exact common stretches of ``LEAST`` words or more, over line ends.

Every run of ``LEAST`` words (a window) is named by its least hash of ``GRAM`` neighbouring words, its anchor, so equal windows
have equal anchors wherever they stand.  Only windows whose anchor is in two documents or more are compared, by a digest
of all their words.  Of equal windows, those in the first document (by doc_id) stay; all words of the others are
repeated.  Windows that follow one another and have places in step in the first document make one stretch; where that document has a
window several times (as a line of one pair of words has), the place in step is taken, else the one of the same number, and
after the last the first again.

Cases: null and empty texts, and those under ``LEAST`` words, have no windows; a text of any length is searched whole; repeats within one
document only are left alone; rows without ``doc_id`` take no part; rows that share a ``doc_id`` count as one document; of equal places the
first by ``doc_id`` stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .words import Words, mix, run_hashes, slices

LEAST, GRAM = 50, 16
#: Places of an anchor that are compared in one group (a million windows or so, which a task passes through in seconds); beyond
#: that its windows are dealt out one by one.
LARGE = 1 << 15
#: Anchors that are sent to every task rather than joined by a shuffle, where there are no more of them.
BROADCAST_ROWS = 500_000


def text_digests(words: Words, n: int) -> np.ndarray:
    """A hash of all words of each of ``n`` texts."""
    ends = np.searchsorted(words.row, np.arange(n + 1))
    return run_hashes(words.hash, ends[:-1], ends[1:]).view(np.int64)


class Anchors:
    """Runs of windows with one anchor: ``begin``, ``stop`` (first words, among all), ``row`` and ``anchor``."""

    def __init__(self, texts: pa.Array):
        self.words = w = Words(texts)
        n = len(w) - LEAST + 1
        if n <= 0:
            self.begin = self.stop = self.row = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.int64)
            return
        at = np.arange(len(w) - GRAM + 1)
        low, step, span = run_hashes(w.hash, at, at + GRAM), 1, LEAST - GRAM + 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[: step - span], low[span - step :])
        within = w.row[:n] == w.row[LEAST - 1 :]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (w.row[1:n] != w.row[: n - 1]) | (within[1:] != within[:-1])])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], n)
        some = within[begin]
        self.begin, self.stop = begin[some], stop[some]
        self.row, self.anchor = w.row[self.begin], low[self.begin].view(np.int64)


def _own(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _anchors(docs: DataFrame) -> DataFrame:
    """``anchor, doc_id`` of every run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch):
                a = Anchors(texts)
                if len(a.begin):
                    yield pa.RecordBatch.from_pydict({"anchor": pa.array(a.anchor), "doc_id": some.column("doc_id").take(pa.array(a.row))})

    return _own(docs).mapInArrow(run, "anchor bigint, doc_id bigint")


def _listed(column: pa.Array) -> np.ndarray:
    """A hash of (row, value) for every value of a list column."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return mix(mix(np.repeat(np.arange(len(column)), sizes).astype(np.uint64)) + column.flatten().to_numpy(zero_copy_only=False).view(np.uint64))


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, doc_id, of, start, windows``: digests of the windows that follow one another from ``start``, by anchor, or by
    themselves for anchors of many places; ``of`` is their text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch):
                a = Anchors(texts)
                w, pair = a.words, mix(mix(a.row.astype(np.uint64)) + a.anchor.view(np.uint64))
                asked = np.isin(pair, _listed(some.column("anchors")))
                if not asked.any():
                    continue
                of = text_digests(w, len(texts))
                begin, stop, key, pair = a.begin[asked], a.stop[asked], a.anchor[asked], pair[asked]
                n = stop - begin
                at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                digest = run_hashes(w.hash, at, at + LEAST).view(np.int64)
                alone = np.repeat(np.isin(pair, _listed(some.column("large"))), n)
                first = alone.copy()
                first[np.cumsum(n) - n] = True
                start = np.flatnonzero(first)
                rows = w.row[at[start]]
                keys = np.where(alone[start], digest[start], np.repeat(key, n)[start])
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(at)), type=pa.int32()), pa.array(digest))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "doc_id": some.column("doc_id").take(pa.array(rows)), "of": pa.array(of[rows]), "start": pa.array(w.index[at[start]].astype(np.int32)), "windows": lists})

    return _own(docs).join(wanted.hint("merge"), "doc_id").mapInArrow(run, "key bigint, doc_id bigint, of bigint, start int, windows array<bigint>")


def _holds(places: list[int], place: int) -> bool:
    """Whether ``place`` is one of ``places``, which rise."""
    k = bisect_left(places, place)
    return k < len(places) and places[k] == place


def _matches(windows: DataFrame) -> DataFrame:
    """``doc_id, of, start, stop, class_doc, step``: words that an earlier document has, ``step`` words further on."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    names = ["doc_id", "of", "start", "stop", "class_doc", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, owner, seen, met = None, None, {}, {}
        for batch in batches:
            out = []
            for key, doc, of, start, digests in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "of", "start", "windows")), strict=True):
                if key != current:
                    current, owner, seen = key, None, {}
                if (doc, of) != owner:
                    owner, met = (doc, of), {}
                last = None
                for i, d in enumerate(digests, start):
                    # a group's rows come by document and place
                    first_doc, first_of, places = seen.setdefault(d, (doc, of, []))
                    if first_doc == doc:
                        last = None
                        if first_of == of:
                            places.append(i)
                        continue
                    nth = met[d] = met.get(d, -1) + 1
                    if last and last[4] == first_doc and _holds(places, i + last[5]):
                        last[3] = i + LEAST
                    else:
                        out.append(last := [doc, of, i, i + LEAST, first_doc, places[nth % len(places)] - i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    ordered = windows.repartition("key").sortWithinPartitions("key", "doc_id", "of", "start")
    return ordered.mapInArrow(run, "doc_id bigint, of bigint, start int, stop int, class_doc bigint, step int")


def stretches(docs: DataFrame) -> DataFrame:
    """``doc_id, start_word, n_words, class_doc_id, class_start, of``: every stretch that an earlier document has too, with its
    first place and its text's digest."""
    anchors = materialize(_anchors(docs).distinct(), "anchors")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = materialize(shared.select("anchor", (F.col("n") > LARGE).alias("many")), "shared-anchors", gather=True)
    few = shared.count() <= BROADCAST_ROWS
    places = anchors.join(F.broadcast(shared) if few else shared, "anchor")
    wanted = materialize(places.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("many"), F.col("anchor"))).alias("large")), "wanted-anchors")
    found = _matches(_windows(docs, wanted))
    # matches in step that overlap or touch are one stretch
    order = Window.partitionBy("doc_id", "of", "class_doc", "step").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = found.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = begun.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("doc_id", "of", "class_doc", "step", "nth").agg(F.min("start").alias("start_word"), F.max("stop").alias("stop"))
    return whole.select("doc_id", "start_word", (F.col("stop") - F.col("start_word")).alias("n_words"), F.col("class_doc").alias("class_doc_id"), (F.col("start_word") + F.col("step")).alias("class_start"), "of")
