"""Spelling variants by a dictionary of trie-node pairs.

Words are counted over all documents, map-side first.  The frequent ones make two tries, of the words and of the reversed words, whose
nodes are numbered by a scan over range-sorted words: a prefix's node is numbered by the first word that has it, and the few
prefixes that go on from one partition into the next take their number from where they began.  So a word is a path of integers forward
and one backward, and leaving out its i-th character is a pair (prefix node, suffix node).  Such pairs are joined:

- two words that meet in the pair of a *skipped* position differ in that character;
- a word's pair at a *gap*, between its characters or at its ends, is the whole word; a longer word that meets it there by a skipped position
  has one character more.  Of a run of equal characters only the first is skipped for that, so every such pair of words meets once.

A pair's group holds at most one word a letter of the alphabet (90) and one gap, so each word's neighbours are counted, and the commonest
kept, from the group's sums and its first two words; pairs of words are never listed.

Cases: a null text has no words; a null ``doc_id`` stands as the empty string in the digests; texts and words of any length are taken whole; each
of repeated rows counts; of equally common near words the first in code-point order is the form; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .words import slices

#: Words of so many characters and occurrences take part; a form is so many times as common as its variant.
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: One in so many occurrences, by digest, loses a character.
MODULUS = 199
#: Bytes of text whose distinct words are counted at a time; one text is not divided.
SLICE_BYTES = 8 << 20
#: Rounds that follow forms: a form is five times as common, and each round doubles the steps taken.
MAX_ROUNDS = 32
SKIP, FIRST_SKIP, GAP = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.array([65 <= b < 91 or 97 <= b < 123 or b == 0xC3 for b in range(256)])
#: Byte lengths of words whose digests are made by table; longer ones are digested one by one.
_SHORT = 64


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _byte_table()


def _moved(crc: np.ndarray, most: int) -> np.ndarray:
    """(most + 1, len(crc)): what ``crc`` becomes behind 0, 1, 2 .. bytes; a text's CRC follows by XOR with that of the bytes."""
    out = np.empty((most + 1, len(crc)), dtype=np.uint32)
    out[0] = crc
    for k in range(most):
        out[k + 1] = (out[k] >> np.uint32(8)) ^ _CRC[out[k] & np.uint32(255)]
    return out


def runs(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The text of every run of letters (A-Z, a-z, U+00C0 to U+00FF), and the runs, A-Z lower-cased, numbered."""
    wide = pa.large_string()
    ended = pc.binary_join_element_wise(texts.cast(wide), pa.scalar("", wide), pa.scalar("\n", wide))
    offsets = np.frombuffer(ended.buffers()[1], dtype=np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = np.frombuffer(ended.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(ended) else np.zeros(0, np.uint8)
    letter = _LETTER[data]
    letter[1:] |= data[:-1] == 0xC3  # the byte behind it is the letter's second
    before = np.concatenate([[False], letter])
    begin, end = np.flatnonzero(~before[:-1] & letter), np.flatnonzero(before[:-1] & ~letter)
    bounds = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    own = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[letter]]))
    return np.searchsorted(offsets - offsets[0], begin, side="right") - 1, own.dictionary_encode()


def _counted(ids: list[str], texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of some texts, the changed occurrences among them, and their numbers."""
    row, coded = runs(texts)
    code, words = coded.indices.to_numpy(), coded.dictionary
    spelled = [w.encode() for w in words.to_pylist()]
    size = np.array([len(w) for w in spelled], dtype=np.int64)
    start = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
    own = np.array([zlib.crc32(w) for w in spelled], dtype=np.uint32)
    short = size[code] <= _SHORT
    crc = np.zeros(len(code), dtype=np.uint32)
    crc[short] = _moved(start, _SHORT)[size[code[short]], row[short]] ^ own[code[short]]
    for i in np.flatnonzero(~short):
        crc[i] = zlib.crc32(spelled[code[i]], int(start[row[i]]))
    hit = crc % MODULUS == 0
    changed: Counter[str] = Counter()
    for c, h in zip(code[hit].tolist(), crc[hit].tolist(), strict=True):
        word = spelled[c].decode()
        at = h % len(word)
        changed[word[:at] + word[at + 1 :]] += 1
    n = np.bincount(code[~hit], minlength=len(words))
    both = pa.concat_arrays([words, pa.array(changed.keys(), pa.large_string())])
    n = np.concatenate([n, np.fromiter(changed.values(), np.int64, len(changed))]).astype(np.int64)
    some = (n > 0) & (pc.utf8_length(both).to_numpy(zero_copy_only=False) >= LEAST_CHARS)
    return both.filter(pa.array(some)), n[some]


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words that take part."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch, most=SLICE_BYTES):
                words, n = _counted(some.column("id").to_pylist(), texts)
                yield pa.RecordBatch.from_pydict({"word": words.cast(pa.string()), "n": pa.array(n)})

    found = own.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT)


def _common(a: str, b: str) -> int:
    """Characters at the beginning that ``a`` and ``b`` share."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class Path:
    """The first word (its number) that has each prefix of a word, as runs: from ``depths[k]`` on it is ``firsts[k]``."""

    def __init__(self, depths: list[int], firsts: list[int]):
        self.depths, self.firsts = depths, firsts

    def turned(self, common: int, first: int) -> Path:
        """The path of the next word, which shares ``common`` characters and is numbered ``first``."""
        keep = int(np.searchsorted(self.depths, common, side="right"))
        return Path([*self.depths[:keep], common + 1], [*self.firsts[:keep], first])

    def placed(self, offset: int, common: int, before: Path | None) -> Path:
        """A partition's path among all: ``before`` is that of the last word before the partition, ``common`` what its first word shares with it."""
        if before is None or common < 0:
            return Path(self.depths, [offset + f for f in self.firsts])
        # the run of the partition's first word is the only one that may have begun before it
        end = self.depths[1] if len(self.depths) > 1 else None
        shared = common if end is None else min(common, end - 1)
        keep = int(np.searchsorted(before.depths, shared, side="right"))
        depths, firsts = list(before.depths[:keep]), list(before.firsts[:keep])
        if end is None or shared + 1 < end:
            depths.append(shared + 1)
            firsts.append(offset + self.firsts[0])
        return Path(depths + self.depths[1:], firsts + [offset + f for f in self.firsts[1:]])

    def nodes(self, length: int) -> np.ndarray:
        """Node numbers of the prefixes of 0, 1 .. ``length`` characters: the first word's number, and the depth."""
        starts = np.minimum(np.array(self.depths, dtype=np.int64), length + 1)
        ends = np.append(starts[1:], length + 1)
        return np.repeat(np.array(self.firsts, dtype=np.int64), ends - starts) + np.arange(length + 1)


def numbered(words: DataFrame, label: str) -> DataFrame:
    """``word, nodes`` of distinct words ``words(word)``: the trie nodes of its prefixes, the empty one first.

    Numbers ascend with the words in code-point order; a word takes as many as it has prefixes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, path, at = TaskContext.get().partitionId(), None, Path([0], [0]), 0
        for batch in batches:
            own = batch.column("word").to_pylist()
            depths, firsts, begun = [], [], []
            for word in own:
                if last is not None:
                    path = path.turned(_common(last, word), at)
                depths.append(path.depths)
                firsts.append(path.firsts)
                begun.append(at)
                last, at = word, at + len(word) + 1
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(own, pa.string()), "part": pa.array([part] * len(own), pa.int32()), "begun": pa.array(begun, pa.int64()),
                "depths": pa.array(depths, pa.list_(pa.int32())), "firsts": pa.array(firsts, pa.list_(pa.int64())),
            })

    in_order = words.select("word").repartitionByRange("word").sortWithinPartitions("word")
    paths = materialize(in_order.mapInArrow(scan, "word string, part int, begun bigint, depths array<int>, firsts array<bigint>"), f"{label}-paths")

    # one row a partition: what its first word shares with the last one before, and the path of its last word
    last = F.max_by(F.struct("word", "depths", "firsts"), "begun").alias("last")
    ends = paths.groupBy("part").agg(F.max(F.col("begun") + F.length("word") + 1).alias("size"), F.min_by("word", "begun").alias("first"), last)
    ends = ends.withColumn("before", F.lag("last.word").over(Window.orderBy("part"))).select("part", "size", "first", "before", "last.depths", "last.firsts")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [-1 if b is None else _common(b, a) for a, b in zip(batch.column("first").to_pylist(), batch.column("before").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("part", "size", "depths", "firsts")], pa.array(common, pa.int32())], names=["part", "size", "depths", "firsts", "common"])

    places: dict[int, tuple[int, int, Path | None]] = {}
    offset, before = 0, None
    for r in sorted(ends.mapInArrow(shares, "part int, size bigint, depths array<int>, firsts array<bigint>, common int").collect()):  # a row a partition
        places[r["part"]] = (offset, r["common"], before)
        before = Path(r["depths"], r["firsts"]).placed(offset, r["common"], before)
        offset += r["size"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, parts, depths, firsts = (batch.column(c).to_pylist() for c in ("word", "part", "depths", "firsts"))
            nodes = [Path(d, f).placed(*places[p]).nodes(len(w)) for w, p, d, f in zip(own, parts, depths, firsts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in nodes])]), pa.int32()), pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), lists], names=["word", "nodes"])

    return paths.select("word", "part", "depths", "firsts").mapInArrow(place, "word string, nodes array<bigint>")


def _pairs(words: DataFrame) -> DataFrame:
    """``p, s, id, n, kind`` of every skipped position and gap of ``words(word, id, n, nodes, back)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.utf8_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64)
            nodes, back = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("nodes", "back"))
            row = np.repeat(np.arange(len(size)), size + 1)
            first = np.cumsum(size + 1) - size - 1
            i = np.arange(len(row)) - first[row]
            letters = np.frombuffer("\0".join([*batch.column("word").to_pylist(), ""]).encode("utf-32-le"), dtype=np.uint32)
            new = np.concatenate([[True], letters[1:] != letters[:-1]]) | (i == 0)
            some = i < size[row]
            mirror = first[row] + size[row] - i
            skips = (nodes[some], back[mirror[some] - 1], row[some], np.where(new[some], FIRST_SKIP, SKIP))
            gaps = (nodes, back[mirror], row, np.full(len(row), GAP))
            p, s, of, kind = (np.concatenate(x) for x in zip(skips, gaps, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(s), batch.column("id").take(pa.array(of)), batch.column("n").take(pa.array(of)), pa.array(kind.astype(np.int8))], names=["p", "s", "id", "n", "kind"])

    return words.select("word", "id", "n", "nodes", "back").mapInArrow(run, "p bigint, s bigint, id bigint, n bigint, kind tinyint")


def _near(p: np.ndarray, s: np.ndarray, word: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, near words, the commonest's n, the commonest) of whole groups of equal pairs that follow one another, a row a word and kind of nearness."""
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
    group = np.cumsum(new) - 1
    some = np.bincount(group)[group] > 1
    group, word, n, kind = group[some], word[some], n[some], kind[some]
    if not len(group):
        return word, word, word, word
    _, group = np.unique(group, return_inverse=True)
    k = group.max() + 1
    out = []

    def first_two(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By group, how many rows ``of`` it has, and the first two by falling ``n`` and word; -1 where there is none."""
        at = np.flatnonzero(of)
        at = at[np.lexsort((word[at], -n[at], group[at]))]
        counts = np.bincount(group[at], minlength=k)
        start = np.cumsum(counts) - counts
        one, two = np.full(k, -1), np.full(k, -1)
        one[counts > 0] = at[start[counts > 0]]
        two[counts > 1] = at[start[counts > 1] + 1]
        return counts, one, two

    counts, one, two = first_two(kind != GAP)
    at = np.flatnonzero((kind != GAP) & (counts[group] > 1))
    best = np.where(one[group[at]] == at, two[group[at]], one[group[at]])
    out.append((word[at], counts[group[at]] - 1, n[best], word[best]))
    longer, most, _ = first_two(kind == FIRST_SKIP)
    _, gap, _ = first_two(kind == GAP)
    at = np.flatnonzero((kind == GAP) & (longer[group] > 0))
    out.append((word[at], longer[group[at]], n[most[group[at]]], word[most[group[at]]]))
    at = np.flatnonzero((kind == FIRST_SKIP) & (gap[group] >= 0))
    out.append((word[at], np.ones(len(at), np.int64), n[gap[group[at]]], word[gap[group[at]]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _neighbours(pairs: DataFrame) -> DataFrame:
    """``id, n_near, best_n, best`` of words that have near words."""
    names = ("p", "s", "id", "n", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in _near(*columns)], names=["id", "near", "best_n", "best"])

        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            held = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            # the last group may go on in the next batch
            if len(held[0]):
                others = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                if len(others):
                    cut = int(others[-1]) + 1
                    yield found([x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield found(held)

    groups = pairs.repartition("p", "s").sortWithinPartitions("p", "s")
    rows = groups.mapInArrow(run, "id bigint, near bigint, best_n bigint, best bigint")
    best = F.max_by("best", F.struct(F.col("best_n"), (-F.col("best")).alias("first"))).alias("best")
    return rows.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best_n").alias("best_n"), best)


def _roots(forms: DataFrame) -> DataFrame:
    """``id, root`` of ``forms(id, form)``: the last form of each word."""
    now = materialize(forms.select("id", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = materialize(now.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if joined.where("moved").isEmpty():
            return joined.select("id", "root")
        now = joined.select("id", "root")
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that takes part."""
    words = materialize(vocabulary(docs), "vocabulary")
    ahead = numbered(words, "forward")
    back = numbered(words.select(F.reverse("word").alias("word")), "backward").select(F.reverse("word").alias("word"), F.col("nodes").alias("back"))
    # a word's own node is its number
    placed = words.join(ahead, "word").join(back, "word").withColumn("id", F.element_at("nodes", -1))
    placed = materialize(placed.select("id", "word", "n", "nodes", "back"), "node-paths")
    near = materialize(_neighbours(_pairs(placed)), "near-words")
    own = placed.select("id", "word", "n")
    counted = own.join(near, "id", "left").withColumn("form_n", F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best_n")))
    counted = materialize(counted.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n", F.when(F.col("form_n").isNotNull(), F.col("best")).alias("form")), "forms")
    forms = counted.where("form is not null").select("id", "form")
    name = lambda of: own.select(F.col("id").alias(of), F.col("word").alias(f"{of}_word"))
    # tables, so that Spark can divide the rows of a form that very many words have
    named = forms.join(_roots(forms), "id").join(name("form"), "form").join(name("root"), "root").select("id", "form_word", "root_word")
    named = materialize(named, "named-forms")
    return counted.join(named, "id", "left").select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
