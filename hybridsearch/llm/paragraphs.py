"""Substring deduplication by MinHash banding of paragraphs.

A paragraph is a block between blank lines, or a line where a text has no blank lines.  All are compared, those of fewer words than a
shingle as wholes; a caller may leave out short ones (``min_words``).

Equal paragraphs are grouped by a digest first.  Bands of MinHash values over five-word shingles, their
number chosen for the recall wanted, bring similar ones together; pairs in a bucket are verified by the exact
Jaccard coefficient of their shingles.  In a large bucket all paragraphs are compared with its first one, which
settles those that are similar to it with one link each; the others are compared with all in blocks, each pair of blocks a
task of its own.  So a bucket of copies that differ in a word costs a comparison each, and no link between classes is lost.
Only a spanning forest of the verified links is kept; its components are the classes.  Of a class
that occurs in two documents or more, the first paragraph (by doc_id, then place) stays, the others go.

Passages inside a paragraph, and over several short lines, are not paragraphs: exact stretches of 50 words and more
(``stretches``), found wherever they begin, go as a whole besides.

Cases: a null or empty text has no paragraphs; a text of any length is cut and compared whole; rows
without ``doc_id`` take no part and stay as they are; rows that share a ``doc_id`` count as one document; repeats
within one document only are left alone; of equal places the first by ``doc_id`` stays; an empty table gives no rows; other columns,
whatever their names, are ignored (``removed`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components
from .stretches import stretches, text_digests
from .words import Words, mix, run_hashes, shingles, slices

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.99
ROWS = 3
#: Members of a bucket that are compared with one another in one task; larger buckets are divided.
BLOCK = 400
#: Bands that are sent to every task rather than joined by a shuffle, where there are no more of them.
BROADCAST_ROWS = 500_000


#: Odd factors, one a MinHash value.
_FACTORS = mix(np.arange(1, 1001, dtype=np.uint64)) | np.uint64(1)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` values that let a pair at ``similarity`` meet with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


class Paragraphs:
    """Paragraphs of some texts: ``row``, ``start`` (word in the text), ``n_words``, ``digest``, and their words' hashes."""

    def __init__(self, texts: pa.Array, min_words: int = 1):
        self.words = w = Words(texts)
        n = len(w)
        lines = np.diff(w.line, prepend=0)
        new_text = np.diff(w.row, prepend=-1) > 0
        in_blocks = np.zeros(len(texts), dtype=bool)
        in_blocks[w.row[(lines > 1) & ~new_text]] = True
        begin = np.flatnonzero(new_text | (lines > np.where(in_blocks[w.row], 1, 0)))
        stop = np.append(begin[1:], n)[: len(begin)]
        long = stop - begin >= min_words
        self.begin, self.stop = begin[long], stop[long]
        self.row, self.start, self.n_words = w.row[self.begin], w.index[self.begin], self.stop - self.begin
        self.digest = run_hashes(w.hash, self.begin, self.stop).view(np.int64)
        self.shingles = shingles(w.hash, WIDTH)

    def __len__(self) -> int:
        return len(self.begin)

    def bands(self, n: int) -> np.ndarray:
        """(paragraphs of ``WIDTH`` words or more, n) band hashes."""
        some = self.n_words >= WIDTH
        if not some.any():
            return np.zeros((0, n), dtype=np.int64)
        ends = np.stack([self.begin[some], self.stop[some] - WIDTH + 1], axis=1).ravel()
        padded = np.append(self.shingles, np.uint64(0))
        out = np.zeros((int(some.sum()), n), dtype=np.uint64)
        for k in range(n * ROWS):
            # an odd factor permutes the hashes, which are mixed already
            least = np.minimum.reduceat(padded * _FACTORS[k], ends)[::2]
            out[:, k // ROWS] = mix(out[:, k // ROWS] + least + np.uint64(k))
        return out.view(np.int64)

    def set_of(self, i: int) -> np.ndarray:
        return np.unique(self.shingles[self.begin[i] : self.stop[i] - WIDTH + 1]).view(np.int64)


def _own(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _places(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, start, n_words, digest`` of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch):
                p = Paragraphs(texts, min_words)
                if len(p):
                    yield pa.RecordBatch.from_pydict({"doc_id": some.column("doc_id").take(pa.array(p.row)), "start": pa.array(p.start.astype(np.int32)), "n_words": pa.array(p.n_words.astype(np.int32)), "digest": pa.array(p.digest)})

    return _own(docs).mapInArrow(run, "doc_id bigint, start int, n_words int, digest bigint")


def _bands(docs: DataFrame, n: int, min_words: int) -> DataFrame:
    """``band, digest, doc_id``: a row for each paragraph and band; the document tells where to find its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch):
                p = Paragraphs(texts, min_words)
                wide = p.n_words >= WIDTH
                if wide.any():
                    yield pa.RecordBatch.from_pydict({"band": pa.array(p.bands(n).ravel()), "digest": pa.array(np.repeat(p.digest[wide], n)), "doc_id": some.column("doc_id").take(pa.array(np.repeat(p.row[wide], n)))})

    return _own(docs).mapInArrow(run, "band bigint, digest bigint, doc_id bigint")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``digest, members``: the shingles of the paragraphs named by ``wanted(doc_id, digests)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch):
                p = Paragraphs(texts)
                asked = [set(x) for x in some.column("digests").to_pylist()]
                found = {int(d): p.set_of(i).tolist() for i, (d, r) in enumerate(zip(p.digest.tolist(), p.row.tolist(), strict=True)) if d in asked[r]}
                if found:
                    yield pa.RecordBatch.from_pydict({"digest": pa.array(found.keys(), type=pa.int64()), "members": pa.array(found.values(), type=pa.list_(pa.int64()))})

    return _own(docs).join(wanted.hint("merge"), "doc_id").mapInArrow(run, "digest bigint, members array<bigint>").dropDuplicates(["digest"])


def _close(both, a, b, least: float):
    return both >= least * (a + b - both) - 1e-6


def _similar(left: list[list[int]], right: list[list[int]], least: float) -> np.ndarray:
    """Which pairs' Jaccard coefficient reaches ``least``."""
    n, size = len(left), np.array([len(s) for s in left + right])
    _, column = np.unique(np.concatenate([np.asarray(s) for s in left + right]), return_inverse=True)
    holds = np.zeros((len(size), column.max() + 1), dtype=np.float32)
    holds[np.repeat(np.arange(len(size)), size), column] = 1
    return _close(holds[:n] @ holds[n:].T, size[:n, None], size[None, n:], least)


def _forest(digests: list[int], pairs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """A spanning forest of ``pairs`` of positions in ``digests``."""
    root = list(range(len(digests)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            yield digests[a], digests[b]


def _verified(rows: list[tuple], least: float) -> list[tuple[int, int]]:
    """Links of one group of rows (..., side, digest, members): within side 0, or between sides 1 and 2."""
    sides = [[r for r in rows if r[-3] == k] for k in (0, 1, 2)]
    out: list[tuple[int, int]] = []
    own = sides[0]
    if len(own) > 1:
        if len(own) <= 8:
            sets = [set(r[-1]) for r in own]
            pairs = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if _close(len(sets[i] & sets[j]), len(sets[i]), len(sets[j]), least)]
        else:
            close = _similar([r[-1] for r in own], [r[-1] for r in own], least)
            pairs = zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1))), strict=True)
        out += _forest([r[-2] for r in own], pairs)
    if sides[1] and sides[2]:
        close = _similar([r[-1] for r in sides[1]], [r[-1] for r in sides[2]], least)
        i, j = np.nonzero(close)
        out += _forest([r[-2] for r in sides[1] + sides[2]], zip(i.tolist(), (len(sides[1]) + j).tolist(), strict=True))
    return [(a, b) for a, b in out if a != b]


def similar_links(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = 1) -> DataFrame:
    """``a, b``: links between the digests of different paragraphs that are similar."""
    n = tune_bands(similarity, recall)
    # bands with two digests or more; copies merge before the shuffle
    shared = _bands(docs, n, min_words).groupBy("band").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high")
    shared = materialize(shared.select("band"), "shared-bands", gather=True)
    few = shared.count() <= BROADCAST_ROWS
    members = _bands(docs, n, min_words).join(F.broadcast(shared) if few else shared, "band").groupBy("band", "digest").agg(F.min("doc_id").alias("doc_id"))
    members = materialize(members, "buckets")
    # tables on both sides of each join, so that Spark can divide the rows of a band that very many paragraphs have
    sizes = materialize(members.groupBy("band").agg(F.count("*").alias("n"), F.min("digest").alias("first")), "bucket-sizes")
    wanted = materialize(members.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("digest").alias("digests")), "wanted")
    sets = materialize(_sets(docs, wanted), "shingle-sets")
    small = members.join(sizes.where(F.col("n") <= BLOCK), "band").select("band", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "digest")

    large = sizes.where(F.col("n") > BLOCK)
    firsts = materialize(large.join(sets, F.col("first") == F.col("digest")).select("band", "n", "first", F.col("members").alias("first_members")), "first-members")
    stars = members.join(firsts, "band").join(sets, "digest").select("band", "n", "first", "digest", F.size("members").alias("a"), F.size("first_members").alias("b"), F.size(F.array_intersect("members", "first_members")).alias("both"))
    close = F.col("both") >= similarity * (F.col("a") + F.col("b") - F.col("both")) - 1e-6
    stars = materialize(stars.select("band", "n", "first", "digest", close.alias("close")), "compared-with-first")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("digest"), blocks).cast("int")
    others = stars.where("not close")
    # blocks of a band that hold others, at most as many as it has others
    held = materialize(others.select("band", block.alias("i")).distinct(), "blocks-of-others")
    left = others.select("band", block.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(1).alias("side"), "digest")
    right = stars.select("band", block.alias("j"), "digest").join(held, "band").select("band", "i", "j", F.lit(2).alias("side"), "digest")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "side", "digest", "members")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows(batches), key=lambda r: r[:3]):
            found = _verified(list(group), similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    # a bucket's rows (of a pair of blocks, if it is large) follow one another
    tasks = small.unionByName(left).unionByName(right).join(sets, "digest")
    sorted_tasks = tasks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    verified = sorted_tasks.mapInArrow(run, "a bigint, b bigint")
    return verified.unionByName(stars.where("close and digest <> first").select(F.col("first").alias("a"), F.col("digest").alias("b"))).distinct()


def repeats(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = 1) -> DataFrame:
    """``doc_id, start_word, n_words, class_doc_id, class_start, class_size, removed, digest``: every paragraph of a class
    that occurs in several documents.  The class is named by its first paragraph's place."""
    places = materialize(_places(docs, min_words), "paragraphs", gather=True)
    classes = connected_components(similar_links(docs, similarity, recall, min_words))
    first = F.min(F.struct("doc_id", "start"))
    digests = places.groupBy("digest").agg(F.count("*").alias("n"), first.alias("first"), F.max("doc_id").alias("last_doc"))
    named = digests.join(classes, digests.digest == classes.node, "left").withColumn("root", F.coalesce("component", "digest"))
    whole = named.groupBy("root").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"), F.max("last_doc").alias("last_doc")).where(F.col("first.doc_id") < F.col("last_doc"))
    of_digest = materialize(named.select("digest", "root").join(whole, "root").select("digest", "class_size", "first"), "classes")
    return places.join(of_digest, "digest").select(
        "doc_id", F.col("start").alias("start_word"), "n_words", F.col("first.doc_id").alias("class_doc_id"), F.col("first.start").alias("class_start"), "class_size",
        ((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))).alias("removed"), "digest",
    )


def repeated(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = 1) -> DataFrame:
    """The columns of ``repeats``: its paragraphs, then whole stretches that an earlier document has too.  Of a stretch, the class
    is named by its first place, and counts that place and the stretches that begin with it; ``digest`` is the whole text's."""
    found = materialize(stretches(docs), "stretches")
    # a table, so that Spark can divide the rows of a class that very many documents have
    sizes = materialize(found.groupBy("class_doc_id", "class_start").agg((F.count("*") + 1).alias("class_size")), "stretch-classes")
    whole = found.join(sizes, ["class_doc_id", "class_start"]).select("doc_id", "start_word", "n_words", "class_doc_id", "class_start", "class_size", F.lit(True).alias("removed"), F.col("of").alias("digest"))
    return repeats(docs, similarity, recall, min_words).unionByName(whole)


def removed(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = 1) -> DataFrame:
    """``docs``, all rows and columns, without the texts' removed paragraphs and stretches."""
    pieces = repeats(docs, similarity, recall, min_words).where("removed").select("doc_id", "start_word", "n_words", "digest")
    pieces = pieces.unionByName(stretches(docs).select("doc_id", "start_word", "n_words", F.col("of").alias("digest")))
    gone = pieces.groupBy(F.col("doc_id").alias("gone_doc")).agg(F.collect_set(F.struct("start_word", "n_words", "digest")).alias("gone_places"))
    columns, name = docs.columns, "gone_places"
    while name in columns:
        name += "_"
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own_row"), F.col("doc_id").cast("bigint").alias("own_id"))
    joined = own.join(gone, F.col("own_id") == F.col("gone_doc"), "left").select("own_row.*", F.col("gone_places").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch):
                lists, kept = some.column(name).to_pylist(), some.column("text").to_pylist()
                hit = [i for i, x in enumerate(lists) if x and kept[i]]
                if hit:
                    words = Words(texts.take(pa.array(hit)))
                    whole = text_digests(words, len(hit))
                    for r, i in enumerate(hit):
                        kept[i] = _without(kept[i], words, r, int(whole[r]), [(x["start_word"], x["n_words"], x["digest"]) for x in lists[i]])
                yield pa.RecordBatch.from_arrays([pa.array(kept, type=pa.string()) if c == "text" else some.column(c) for c in columns], names=columns)

    return joined.mapInArrow(run, docs.schema)


def _without(text: str, words: Words, row: int, whole: int, gone: list[tuple[int, int, int]]) -> str:
    """``text`` without those runs of the row's words whose digest, or the whole text's, is the one named."""
    lo, hi = np.searchsorted(words.row, [row, row + 1])
    own = words.hash[lo:hi]
    inside = sorted((a, a + n, d) for a, n, d in gone if a + n <= len(own))
    if not inside:
        return text
    found = run_hashes(own, np.array([a for a, _, _ in inside]), np.array([b for _, b, _ in inside])).view(np.int64)
    cuts: list[list[int]] = []
    for (a, b, d), of in zip(inside, found.tolist(), strict=True):
        if d not in (whole, of):
            continue
        if cuts and a <= cuts[-1][1]:
            cuts[-1][1] = max(b, cuts[-1][1])
        else:
            cuts.append([a, b])
    data, out, at = text.encode("utf-8"), [], 0
    for a, b in cuts:
        out.append(data[at : words.begin[lo + a]])
        at = words.end[lo + b - 1]
        if at < len(data) and data[at : at + 1] in (b" ", b"\n") and not (out[-1] and out[-1][-1:] not in (b" ", b"\n")):
            at += 1  # not two separators in place of one
    out.append(data[at:])
    return b"".join(out).decode("utf-8")
