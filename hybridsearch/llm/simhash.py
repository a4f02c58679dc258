"""SimHash fingerprints, and near-duplicate groups by vantage-point trees.

A bounded sample of distinct fingerprints fixes a vantage-point tree: each node has a vantage point and
a radius, and divides the space into near (distance <= radius) and far.  Every fingerprint goes to its
leaf ("shard"); one that lies within the search distance inside a node's boundary also goes down the far
side, so that by the triangle inequality any two fingerprints within the distance meet in a shard.

The sample is small, so shards differ in size.  Those of more than ``MOST`` fingerprints are divided again, all of them
in one pass over their rows, by the same rule: a vantage point of the shard's own, and the median of its exact
distances, which are counted.  This goes on until none is larger; a shard that no boundary thins (a ball of
fingerprints that differ in a few bits) is compared in blocks, each pair of blocks a task.

Within a shard links are found exactly, and only a spanning forest of them is passed on, so a group of k
copies costs k rows, not k * k.  Components of the forest's links are those of all links.

Cases: null and empty texts have fingerprint zero and are linked like any other; a text of any length counts whole; rows with
equal ``doc_id`` each keep a row, and may be in different groups; a null ``doc_id`` links too but names a group only if nothing
else is in it (then null); repeated rows are one point; an empty table gives no rows; other columns, whatever their names,
are ignored (``representatives`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts_of
from .graph import connected_components

#: Fingerprints the driver gets to place vantage points; the tree's shape, not its results, depends on it.
SAMPLE = 20_000
#: Aim for so many fingerprints in a shard, and divide those with more than MOST again.
SHARD, MOST = 6_000, 12_000
#: A node of the tree that is sent to every task is divided only while more sample points come to it.
LEAF_SAMPLE = 16
#: A task compares so many fingerprints with one another directly.
LEAF = 1_500
SEED = 42
#: Rounds of division that no table needs; a guard against a defect, not a limit on results.
MAX_TURNS = 200


def fingerprint(text: str, width: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64; 0 for a text without words."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 65536):
        some = hashes[lo : lo + 65536]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (bigint with the fingerprint's bits) for every row of ``docs(doc_id, text)``; a null text has no words."""

    def run(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(t, width) for t in texts_of(batch)], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fp.view(np.int64))}

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, fp bigint")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _divide(points: np.ndarray, reach: int, vantage: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Near side, and far side with those that lie within ``reach`` inside the boundary."""
    d = _distance(points, vantage).astype(np.int16)
    return d <= radius, d > radius - reach


def _median_radius(points: np.ndarray, vantage: np.uint64) -> int:
    return int(np.median(_distance(points, vantage)))


class Tree:
    """Vantage points and radii; ``child`` has each node's near and far child, or a shard's number k as -1 - k.

    A node is divided while more than ``most`` of the sample's points come to it, those near boundaries counted on both sides.
    """

    def __init__(self, sample: np.ndarray, most: float, reach: int):
        rng = np.random.default_rng(0)
        self.reach, self.n_shards = reach, 0
        self.vantage: list[np.uint64] = []
        self.radius: list[int] = []
        self.child: list[list[int]] = []
        self.first = self._grow(sample, max(most, LEAF_SAMPLE), rng)

    def _grow(self, points: np.ndarray, most: float, rng: np.random.Generator) -> int:
        if len(points) > most:
            vantage = rng.choice(points)
            radius = _median_radius(points, vantage)
            near, far = _divide(points, self.reach, vantage, radius)
            if max(near.sum(), far.sum()) < 0.9 * len(points):
                k = len(self.vantage)
                self.vantage.append(vantage)
                self.radius.append(radius)
                self.child.append([])
                self.child[k] = [self._grow(points[near], most, rng), self._grow(points[far], most, rng)]
                return k
        self.n_shards += 1
        return -self.n_shards

    def shards(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, indices into ``points``) of all shards that points go to."""
        todo = [(self.first, np.arange(len(points)))]
        while todo:
            k, own = todo.pop()
            if not len(own):
                continue
            if k < 0:
                yield -1 - k, own
                continue
            near, far = _divide(points[own], self.reach, self.vantage[k], self.radius[k])
            todo += [(self.child[k][0], own[near]), (self.child[k][1], own[far])]


class _Union:
    """Groups of 0..n-1; a group's root is its smallest member."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)

    def links(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point that is no root, and its root."""
        roots = np.array([self.find(i) for i in range(len(points))], dtype=np.int64)
        linked = roots != np.arange(len(points))
        return points[linked], points[roots[linked]]


def _forest(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of ``points`` at ``reach``: in small leaves of a local vantage-point tree."""
    rng, groups = np.random.default_rng(1), _Union(len(points))
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) > LEAF:
            vantage = points[rng.choice(own)]
            near, far = _divide(points[own], reach, vantage, _median_radius(points[own], vantage))
            # a dense ball that a boundary cannot thin out is compared as it is
            if max(near.sum(), far.sum()) < 0.9 * len(own):
                todo += [own[near], own[far]]
                continue
        values = points[own]
        for lo in range(0, len(own), 256):
            i, j = np.nonzero(_distance(values[lo : lo + 256, None], values[None, lo:]) <= reach)
            some = i < j
            groups.add(own[lo + i[some]], own[lo + j[some]])
    return groups.links(points)


def _forest_between(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the pairs of one of ``a`` and one of ``b``."""
    groups = _Union(len(a) + len(b))
    for lo in range(0, len(a), 256):
        i, j = np.nonzero(_distance(a[lo : lo + 256, None], b[None, :]) <= reach)
        groups.add(lo + i, len(a) + j)
    return groups.links(np.concatenate([a, b]))


def _divided(shards: DataFrame, reach: int) -> DataFrame:
    """``shard, i, j, own, fp`` of ``shards(shard, fp)``: no group of (shard, i, j) has more than about MOST fingerprints.

    i = j = 0 but for shards that cannot be thinned: there (i, j) are pairs of blocks, and a fingerprint is in all pairs with its ``own`` block.
    """
    small: list[DataFrame] = []
    rest = shards
    for turn in range(MAX_TURNS):
        sizes = rest.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(turn))).alias("vantage"))
        sizes = materialize(sizes, "shard-sizes")
        large = sizes.where(F.col("n") > MOST)
        whole = rest.join(sizes.where(F.col("n") <= MOST).select("shard"), "shard", "left_semi")
        small.append(whole.select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "fp"))
        if large.isEmpty():
            break
        apart = rest.join(large, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))))
        apart = materialize(apart, "large-shards")
        # at most 65 rows a shard
        counts = apart.groupBy("shard", "n", "d").agg(F.count("*").alias("k")).withColumn("up_to", F.sum("k").over(Window.partitionBy("shard").orderBy("d")))
        radius = counts.where(2 * F.col("up_to") >= F.col("n")).groupBy("shard").agg(F.min("d").alias("radius"))
        sides = counts.join(radius, "shard").groupBy("shard", "radius").agg(
            F.sum(F.when(F.col("d") <= F.col("radius"), F.col("k"))).alias("near"), F.coalesce(F.sum(F.when(F.col("d") > F.col("radius") - reach, F.col("k"))), F.lit(0)).alias("far"), F.first("n").alias("of")
        )
        plan = materialize(sides.select("shard", "radius", (F.greatest("near", "far") < 0.9 * F.col("of")).alias("thins")), "shard-radii")
        placed = apart.join(plan, "shard")
        near, far = F.col("d") <= F.col("radius"), F.col("d") > F.col("radius") - reach
        into = F.filter(F.array(F.when(near, F.xxhash64("shard", F.lit(turn), F.lit(0))), F.when(far, F.xxhash64("shard", F.lit(turn), F.lit(1)))), lambda x: x.isNotNull())
        rest = placed.where("thins").select(F.explode(into).alias("shard"), "fp")
        blocks = F.ceil(F.col("n") / (MOST // 2)).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit(-1)), blocks).cast("int")
        paired = placed.where("not thins").select("shard", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        small.append(paired.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp"))
    else:
        raise RuntimeError("shards were not divided")
    return reduce(DataFrame.unionByName, small)


def links(distinct: DataFrame, reach: int = 2) -> DataFrame:
    """``a, b``: a spanning forest, shard by shard, of all pairs of ``distinct(fp)`` within ``reach`` bits."""
    n = distinct.count()
    share = min(1.0, 2 * SAMPLE / max(n, 1))
    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * share)).limit(SAMPLE)
    points = np.sort(np.array([r.fp for r in sample.collect()], dtype=np.int64)).view(np.uint64)
    tree = Tree(points, SHARD * len(points) / max(n, 1), reach)

    def place(batch: pa.RecordBatch) -> dict | None:
        fp = batch.column("fp").to_numpy()
        found = list(tree.shards(fp.view(np.uint64)))
        return {"shard": pa.array(np.concatenate([np.full(len(own), k, dtype=np.int64) for k, own in found])), "fp": pa.array(np.concatenate([fp[own] for _, own in found]))}

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points, (_, i, j) = np.sort(group["fp"].to_numpy()).view(np.uint64), key
        if i == j:
            a, b = _forest(points, reach)
        else:
            # links within either block are another task's
            first = group["own"].to_numpy() == i
            a, b = _forest_between(group["fp"].to_numpy()[first].view(np.uint64), group["fp"].to_numpy()[~first].view(np.uint64), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    shards = materialize(map_batches(distinct, place, "shard bigint, fp bigint"), "shards")
    return _divided(shards, reach).groupBy("shard", "i", "j").applyInPandas(join, "a bigint, b bigint")


def _grouped(rows: DataFrame, reach: int) -> DataFrame:
    """``fp, component_id``: the least ``doc_id`` of each fingerprint's group; ``rows(doc_id, fp)``."""
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = connected_components(links(least.select("fp"), reach))
    named = least.join(groups, least.fp == groups.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    # of each group also the fingerprint that its first row has: the row with the least doc_id, and of those the least fingerprint
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min(F.struct(F.col("least").isNull(), "least", "fp"))["fp"].alias("kept_fp"))
    return materialize(named.join(ids, "root").select("fp", "component_id", "kept_fp"), "fingerprint-groups")


def near_duplicates(docs: DataFrame, reach: int = 2, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``."""
    rows = materialize(fingerprints(docs, width), "fingerprints")
    # tables on both sides, so that Spark can divide the rows of a fingerprint that very many have
    return rows.join(_grouped(rows, reach), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, reach: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each group the row with the smallest ``doc_id`` stays, of
    several rows with that ``doc_id`` one with the smallest fingerprint.

    Rows without ``doc_id`` all stay, since they cannot be told apart.
    """
    rows = materialize(fingerprints(docs, width), "fingerprints")
    of_row = rows.join(_grouped(rows, reach), "fp").where("doc_id is not null").select("doc_id", F.when((F.col("doc_id") == F.col("component_id")) & (F.col("fp") == F.col("kept_fp")), F.col("fp")).alias("kept_fp"))
    kept = of_row.groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n"), F.collect_set("kept_fp").alias("kept_fps")).where(F.size("kept_fps") > 0)
    kept = materialize(kept, "kept-rows")
    own = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    single = own.join(kept.where("n = 1"), own.key == kept.kept_id, "left_semi")
    out = single.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
    if kept.where("n > 1").isEmpty():
        return out  # no second pass over the texts
    # where a doc_id is repeated, a row is told by its own fingerprint, and one of those that agree in both stays
    several = own.join(kept.where("n > 1"), own.key == kept.kept_id).select("key", "row", "kept_fps", _fingerprint_of(width)(F.col("row.text")).alias("fp"))
    first = several.where(F.array_contains("kept_fps", F.col("fp"))).groupBy("key", "fp").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return out.unionByName(first.select("row.*"))


def _fingerprint_of(width: int):
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", width) for t in texts], dtype=np.uint64).view(np.int64))

    return of
