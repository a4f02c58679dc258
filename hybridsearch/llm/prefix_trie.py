"""The prefix trie of rebuilt conversations, by ternary search trees over range shards.

Turns are digested and numbered within their conversations by a scan over range-sorted rows.  A rebuilt conversation begins with the first
turns of the one that opens its group of five, and is cut into segments of ``LENGTH`` turns, each named by the turns before it.  Segments
are range-sorted by (what is before them, their turns); a shard is a run of them within a partition.  In a shard distinct turns, each with its
place in the conversation, are encoded as small integers, and the distinct segments go into a ternary search tree, the median first, which
keeps it balanced.  An iterative pass, from the last node made to the first, accumulates members, leaves and savings.

Nodes on a shard's first or last path may go on in its neighbours: these *border* nodes are merged by key.  Their own share of leaves and savings
is known only then; it is added along the border paths, each border node's by the first path that has it.  What hangs below the end of a
segment is added in the same way, along the conversation that is the smallest one there.  So nothing gathers a conversation, a node's
members or a subtree in one task: what a task holds is bounded by its shard, and a node's list of ends is hashed as a stream of
packed portions.

Cases: rows without ``conv_id`` take no part; a null role or text is empty; null turns come first; of equal turns numbers the order is by role, then
by the digest of role and text; repeated rows are turns of their own; texts of any length count whole; an empty table gives no rows; other
columns, whatever their names, are ignored.  The group of a negative ``conv_id`` is opened by the next multiple of five below it.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Conversations of a group, the first of which opens the others, and one more than the most turns taken over from it.
GROUP, HEADS = 5, 9
#: Turns in a segment, and segments in a shard.
LENGTH, SHARD = 128, 1 << 14
#: Ids that are packed into one portion of a node's list.
PACK = 1 << 13
#: Merged nodes that are sent to every task rather than joined by a shuffle, where there are no more of them.
BROADCAST_ROWS = 200_000
_KEY = ["k1", "k2"]


def _heads(conv_id: Column) -> Column:
    """Turns that a conversation takes over."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, n_bytes``: every turn with its place in its conversation, from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    ordered = rows.where("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            size = np.diff(np.append(begin, len(conv)))
            at = np.arange(len(conv)) - np.repeat(begin, size)
            if conv[0] == last:
                at[: size[0]] += count
            last, count = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(np.full(len(conv), part), pa.int32())], names=["conv_id", "digest", "n_bytes", "at", "part"])

    turns = materialize(ordered.mapInArrow(scan, "conv_id bigint, digest binary, n_bytes bigint, at bigint, part int"), "turns")
    sizes = turns.groupBy("conv_id", "part").agg((F.max("at") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a partition goes on with one conversation at most
    begun = F.broadcast(sizes.withColumn("before", before).where("before > 0").select("conv_id", "part", "before"))
    return turns.join(begun, ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0)) + 1).alias("pos"), "digest", "n_bytes")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``conv_id, pos, digest, n_bytes`` of the rebuilt conversations, ``conv_id`` of all)."""
    convs = materialize(turns.select("conv_id").distinct(), "conversations")
    own = turns.where(F.col("pos") > _heads(F.col("conv_id")))
    opening = turns.where((F.col("pos") < HEADS) & (F.pmod("conv_id", F.lit(GROUP)) == 0))
    heads = opening.select("conv_id", "pos", "digest", "n_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GROUP - 1).cast("bigint"))).alias("other"))
    heads = heads.select(F.try_add("conv_id", "other").alias("conv_id"), "pos", "digest", "n_bytes")
    heads = materialize(heads.where(F.col("pos") <= _heads(F.col("conv_id"))).join(convs, "conv_id", "left_semi"), "heads")
    taken = convs.join(heads.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left")
    # where there are fewer to take over, the others move up; tables, so that Spark can divide the rows of a long conversation
    gaps = materialize(taken.select("conv_id", (_heads(F.col("conv_id")) - F.coalesce("n", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
    moved = own.join(gaps, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "digest", "n_bytes")
    return heads.unionByName(moved), convs


def segments(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, bool]:
    """(``seg, r1, r2, ids, weights, conv_id, more, e1, e2``, whether any conversation has several): segments of rebuilt conversations.

    ``ids`` name turns at their places, by two digests each; a node's key is the XOR of all on its path: ``r1, r2`` is where the segment
    begins, ``e1, e2`` where it ends; ``more`` says that the conversation goes on.
    """
    one, two = F.xxhash64("digest", "pos"), F.xxhash64("pos", "digest", F.lit(2))
    named = rows.select("conv_id", F.floor((F.col("pos") - 1) / LENGTH).cast("int").alias("seg"), "pos", one.alias("a"), two.alias("b"), "n_bytes")
    cut = named.groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n_bytes"))).alias("turns"), F.bit_xor("a").alias("x1"), F.bit_xor("b").alias("x2"))
    ids, weights = F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"))), F.transform("turns", lambda t: t["n_bytes"])
    cut = materialize(cut.select("conv_id", "seg", ids.alias("ids"), weights.alias("weights"), "x1", "x2"), "cut-conversations")
    zero = F.lit(0).cast("bigint")
    none = convs.join(cut.where("seg = 0").select("conv_id"), "conv_id", "left_anti")
    none = none.select(F.lit(0).alias("seg"), zero.alias("r1"), zero.alias("r2"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("ids"), F.array().cast("array<bigint>").alias("weights"), "conv_id", F.lit(False).alias("more"), zero.alias("e1"), zero.alias("e2"))
    columns = none.columns
    several = not cut.where("seg > 0").isEmpty()
    begun = cut.withColumns({"r1": zero, "r2": zero, "more": F.lit(False)})
    if several:
        long = cut.where("seg > 0").groupBy("conv_id").agg(F.max("seg").alias("last"))
        by_conv = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
        keys = cut.select("conv_id", "seg", "x1", "x2").join(long, "conv_id")
        keys = keys.select("conv_id", "seg", *[F.coalesce(F.bit_xor(f"x{i}").over(by_conv), zero).alias(f"r{i}") for i in (1, 2)], (F.col("seg") < F.col("last")).alias("more"))
        keys = materialize(keys, "segment-keys")
        begun = cut.join(keys, ["conv_id", "seg"], "left").withColumns({"r1": F.coalesce("r1", zero), "r2": F.coalesce("r2", zero), "more": F.coalesce("more", F.lit(False))})
    begun = begun.withColumns({f"e{i}": F.col(f"r{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)})
    return materialize(begun.select(*columns).unionByName(none), "segments"), several


class Shard:
    """A ternary search tree of some segments ``(seg, r1, r2, ids, weights, conv_id, more)`` in order, and what its nodes add up to.

    A segment's beginning is its first symbol.  A trie node is the tree node of its last symbol; trie parents are made before their children.
    """

    def __init__(self, rows: list[tuple]):
        roots: dict[tuple, int] = {}
        pairs: dict[tuple, int] = {}
        self.low: list[int] = []
        self.equal: list[int] = []
        self.high: list[int] = []
        self.symbol: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.key: list[tuple[int, int]] = []
        self.weight: list[int] = []
        self.seg: list[int] = []
        self.n: list[int] = []
        self.first: list[int] = []
        self.more: list[bool] = []
        # equal segments follow one another, the smallest conversation first
        distinct: list[list] = []
        for row in rows:
            if distinct and distinct[-1][0][:4] == row[:4]:
                distinct[-1][1] += 1
                distinct[-1][2] |= row[6]
            else:
                distinct.append([row, 1, row[6]])
        coded = []
        for row, n, more in distinct:
            root = roots.setdefault(row[:3], len(roots))
            coded.append((row, n, more, [root, *[pairs.setdefault(p, len(pairs)) for p in row[3]]]))
        self.top = -1
        ends = {}
        waiting = deque([(0, len(coded))])
        while waiting:
            lo, hi = waiting.popleft()
            if lo < hi:
                mid = (lo + hi) // 2
                ends[mid] = self._insert(*coded[mid])
                waiting += [(lo, mid), (mid + 1, hi)]
        self.paths = [self._path(ends[0]), self._path(ends[len(coded) - 1])]
        self._accumulate()

    def _new(self, symbol: int, parent: int, row: tuple, depth: int) -> int:
        self.low.append(-1)
        self.equal.append(-1)
        self.high.append(-1)
        self.symbol.append(symbol)
        self.parent.append(parent)
        self.depth.append(depth)
        self.seg.append(row[0])
        if parent < 0:
            self.key.append((row[1], row[2]))
            self.weight.append(0)
        else:
            a, b = row[3][depth - 1]
            self.key.append((self.key[parent][0] ^ a, self.key[parent][1] ^ b))
            self.weight.append(row[4][depth - 1])
        self.n.append(0)
        self.first.append(row[5])
        self.more.append(False)
        return len(self.symbol) - 1

    def _insert(self, row: tuple, n: int, more: bool, symbols: list[int]) -> int:
        parent = -1
        for depth, symbol in enumerate(symbols):
            links, at = (self.equal, parent) if parent >= 0 else (None, -1)
            node = self.top if links is None else links[at]
            while node >= 0 and self.symbol[node] != symbol:
                links, at = (self.low, node) if symbol < self.symbol[node] else (self.high, node)
                node = links[at]
            if node < 0:
                node = self._new(symbol, parent, row, depth)
                if links is None:
                    self.top = node
                else:
                    links[at] = node
            parent = node
        self.n[parent] += n
        self.first[parent] = min(self.first[parent], row[5])
        self.more[parent] |= more
        return parent

    def _path(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]

    def _accumulate(self) -> None:
        count = len(self.symbol)
        self.border = [False] * count
        for path in self.paths:
            for v in path:
                self.border[v] = True
        self.kids, self.leaves, self.saved = [0] * count, [0] * count, [0] * count
        for v in range(count - 1, -1, -1):
            p = self.parent[v]
            if not self.border[v] and p >= 0:
                self.leaves[v] += not self.kids[v] and not self.more[v]
                self.saved[v] += (self.n[v] - 1) * self.weight[v]
                self.kids[p] += 1
            if p >= 0:
                self.n[p] += self.n[v]
                self.first[p] = min(self.first[p], self.first[v])
                self.leaves[p] += self.leaves[v]
                self.saved[p] += self.saved[v]


_SHARD_SCHEMA = "kind int, k1 bigint, k2 bigint, depth bigint, p1 bigint, p2 bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, weight bigint, border boolean, path bigint"
_NAMES = [c.split()[0] for c in _SHARD_SCHEMA.split(", ")]
#: Kinds of rows: whole nodes, parts of nodes, parts of segments' beginnings (what is below them), and steps of border paths.
NODE, PART, BEGINNING, STEP = range(4)


def _shards(rows: DataFrame) -> DataFrame:
    """What the shards find, by kind."""
    order = ["seg", "r1", "r2", "ids", "conv_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("seg", "r1", "r2", "ids", "weights", "conv_id", "more")

    def found(shard: Shard, path: int) -> pa.RecordBatch:
        out = []
        for v in range(len(shard.symbol)):
            p, seg, inner = shard.parent[v], shard.seg[v], shard.depth[v] > 0
            kind = BEGINNING if not inner and seg else PART if shard.border[v] or not inner or shard.more[v] else NODE
            of = shard.key[p] if p >= 0 else (None, None)
            known = shard.first[p] if p > 0 and not shard.border[p] and shard.depth[p] > 0 else None
            out.append((kind, *shard.key[v], seg * LENGTH + shard.depth[v], *of, shard.first[v], known, shard.n[v], shard.kids[v], shard.leaves[v], shard.saved[v], shard.weight[v], shard.border[v], None))
        for k, nodes in enumerate(shard.paths):
            for v in nodes:
                out.append((STEP, *shard.key[v], shard.seg[v] * LENGTH + shard.depth[v], None, None, None, None, None, shard.depth[v], None, None, None, None, path + k))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int32(), *[pa.int64()] * 12, pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            ids = [tuple((p["a"], p["b"]) for p in x) for x in batch.column("ids").to_pylist()]
            seg, r1, r2, weights, conv, more = (batch.column(c).to_pylist() for c in ("seg", "r1", "r2", "weights", "conv_id", "more"))
            held += zip(seg, r1, r2, ids, weights, conv, more, strict=True)
            while len(held) >= SHARD:
                yield found(Shard(held[:SHARD]), path)
                held, path = held[SHARD:], path + 2
        if held:
            yield found(Shard(held), path)

    return ordered.mapInArrow(run, _SHARD_SCHEMA)


def _merged(found: DataFrame, kind: int) -> DataFrame:
    """Parts of one kind by key."""
    return found.where(F.col("kind") == kind).groupBy(*_KEY).agg(
        F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("weight").alias("weight"), F.max("border").alias("border"),
    )


def _with(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join; ``right`` is sent to every task where it has few rows."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, "left")


def _nodes(found: DataFrame, several: bool, rows: DataFrame) -> DataFrame:
    """All nodes with ``p1, p2`` and all but the ends' hashes."""
    zero = F.lit(0).cast("bigint")
    parts = materialize(_merged(found, PART), "merged-nodes")
    kids = parts.where("border and p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("border_children"))
    if several:
        # children of border beginnings, and what is below a segment's beginning
        beginnings = materialize(_merged(found, BEGINNING).drop("p1", "p2", "parent_conv_id"), "merged-beginnings")
        below = beginnings.select(*_KEY, F.col("n_children").alias("children_below"))
        parts = parts.join(below, _KEY, "left").withColumn("n_children", F.col("n_children") + F.coalesce("children_below", zero)).drop("children_below")
    parts = parts.join(kids, _KEY, "left").withColumn("n_children", F.col("n_children") + F.coalesce("border_children", zero)).drop("border_children")
    parts = materialize(parts, "merged-children")

    # each border node's own share, along its first path; at a segment's beginning the share is the segment's before
    steps = found.where(F.col("kind") == STEP).select("path", *_KEY, F.col("n_children").alias("step"))
    inner = steps.where("step > 0 or (k1 = 0 and k2 = 0)")
    owner = inner.groupBy(*_KEY).agg(F.min("path").alias("path"))
    own = parts.where("border").select(*_KEY, (F.col("n_children") == 0).cast("bigint").alias("own_leaf"), ((F.col("n_convs") - 1) * F.col("weight")).alias("own_saved")).join(owner, _KEY)
    below = Window.partitionBy("path").orderBy(F.col("step").desc())
    shared = steps.join(own.withColumn("inner", F.lit(True)), [*_KEY, "path"], "left")
    counts = (F.col("step") > 0) | ((F.col("k1") == 0) & (F.col("k2") == 0))
    sums = shared.select(*_KEY, "step", "path", *[F.sum(F.when(counts, F.coalesce(c, zero)).otherwise(zero)).over(below).alias(c) for c in ("own_leaf", "own_saved")])
    sums = materialize(sums, "border-sums")
    upper = sums.where(counts).groupBy(*_KEY).agg(F.sum("own_leaf").alias("more_leaves"), F.sum("own_saved").alias("more_saved"))

    def add(to: DataFrame, of: DataFrame) -> DataFrame:
        both = to.join(of, _KEY, "left")
        return both.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", zero), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", zero)}).drop("more_leaves", "more_saved")

    parts = materialize(add(parts, upper), "border-nodes")
    own_columns = [*_KEY, "depth", "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    own_columns += ["parent_conv_id"]
    nodes = found.where(F.col("kind") == NODE).select(*own_columns).unionByName(parts.select(*own_columns))
    if several:
        lower = sums.where(~counts).groupBy(*_KEY).agg(F.sum("own_leaf").alias("more_leaves"), F.sum("own_saved").alias("more_saved"))
        nodes = add(nodes, _below(rows, materialize(add(beginnings, lower), "below-segments")))
    # parents that are whole nodes are known; the others are merged ones
    parents = parts.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("merged_parent"))
    joined = _with(nodes, parents, ["p1", "p2"])
    return joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "merged_parent")).drop("merged_parent")


def _below(rows: DataFrame, beginnings: DataFrame) -> DataFrame:
    """``k1, k2, more_leaves, more_saved``: what nodes of earlier segments have in later ones.

    What is below a segment's beginning counts for the smallest conversation that goes on there, and so for all nodes on its path.
    """
    zero = F.lit(0).cast("bigint")
    owned = beginnings.select("conv_id", F.floor(F.col("depth") / LENGTH).cast("int").alias("seg"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    long = owned.select("conv_id").distinct()
    later = Window.partitionBy("conv_id").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.select("conv_id", "seg").join(long, "conv_id", "left_semi").join(owned, ["conv_id", "seg"], "left")
    sums = sums.select("conv_id", "seg", *[F.coalesce(F.sum(F.coalesce(c, zero)).over(later), zero).alias(c) for c in ("leaves", "saved")]).where("leaves > 0 or saved > 0")
    paths = rows.join(materialize(sums, "later-segments"), ["conv_id", "seg"]).select("seg", "r1", "r2", "ids", "leaves", "saved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = [np.bitwise_xor.accumulate(np.array([r[f"r{i}"], *[x[c] for x in r["ids"]]], dtype=np.int64))[(r["seg"] > 0) :] for i, c in ((1, "a"), (2, "b"))]
                n = len(keys[0])
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), *[pa.array([r[c]] * n, pa.int64()) for c in ("leaves", "saved")]], names=["k1", "k2", "leaves", "saved"])

    return paths.mapInArrow(run, "k1 bigint, k2 bigint, leaves bigint, saved bigint").groupBy(*_KEY).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def _ends(rows: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the nodes at which conversations end."""
    ends = rows.where("not more").select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, conv = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
            new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            begin = np.flatnonzero(new | ((np.arange(len(k1)) - np.maximum.accumulate(np.where(new, np.arange(len(k1)), 0))) % PACK == 0))
            lists = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(begin, np.append(begin[1:], len(k1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[begin]), pa.array(k2[begin]), pa.array(conv[begin]), pa.array(lists, pa.string())], names=["k1", "k2", "first", "listed"])

    in_order = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    packed = in_order.mapInArrow(pack, "k1 bigint, k2 bigint, first bigint, listed string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for k1, k2, listed in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "listed")), strict=True):
                if (k1, k2) == key:
                    state.update(b"," + listed.encode())
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256(listed.encode())
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["k1", "k2", "ends_sha256"])
                out = []
        if key is not None:
            out.append((*key, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["k1", "k2", "ends_sha256"])

    portions = packed.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return portions.mapInArrow(digest, "k1 bigint, k2 bigint, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: every node of the trie."""
    rows, several = segments(*rebuilt_turns(materialize(numbered_turns(conversations), "numbered-turns")))
    found = materialize(_shards(rows), "shards")
    nodes = _nodes(found, several, rows)
    none = hashlib.sha256(b"").hexdigest()
    ended = nodes.join(materialize(_ends(rows), "ends"), _KEY, "left")
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
