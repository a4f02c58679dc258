"""Quality classifier: regularised quadratic discriminant over transformed text statistics.

Each class has a Gaussian of the statistics; its covariance is shrunk towards the pooled one (by ``pooling``) and that
mixture towards the pooled one's diagonal (by ``ridge``).  Both weights are chosen from the data: the labelled rows are dealt
into folds, and the pair under which each fold is likeliest by the other folds' model wins.  A fold's likelihood needs only its
moments, so one pass over the labelled rows' statistics serves all pairs.

A score is the logistic of the difference of the two log densities, from Mahalanobis distances by the inverses of
Cholesky factors, which are computed once and sent to the tasks.  Labels serve for fitting only; language, source and id
never enter a score.

Cases: a null text is an empty one and gets the score of all-zero statistics; a text of any length is read whole; null labels and labels without
a document are left out, of several labels of one document the largest counts; without labels of
both classes every score is the share of good labels (0.5 without any); repeated rows and rows that share a ``doc_id`` each keep a row; an
empty table gives no rows; other columns, whatever their names, are ignored (``keep`` passes them on).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, texts_of

THRESHOLD = 0.3
#: Weights that are tried: towards the pooled covariance, and of that towards its diagonal.
POOLINGS, RIDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), (0.001, 0.01, 0.1, 0.3)
#: Folds of the labelled rows; variances are at least LEAST_VARIANCE.
FOLDS, LEAST_VARIANCE = 4, 1e-6
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_SYMBOLS, _MARKS = rb"#*$%&|<>!@^~_={}[]\+", b".,;:?'\"()-"
N_STATS = 11


def statistics(text: str) -> list[float]:
    """Logarithms of length, word length, character shares, repetition and line shares; zeros without words."""
    data, words = text.encode("utf-8"), text.split()
    n, k = len(data), len(words)
    if not k:
        return [0.0] * N_STATS
    share = lambda chars: (n - len(data.translate(None, chars))) / n
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = sum(map(str.__eq__, words, words[1:]))
    raw = (k, n / k, share(_UPPER) + 0.01, share(_SYMBOLS) + 0.003, share(_MARKS) + 0.01, share(_DIGITS) + 0.003, len(counts) / k, max(counts.values()) / k + 0.02, 1.02 - len(set(lines)) / len(lines), len(lines) / k + 0.01, pairs / k + 0.02)
    return np.log(raw).tolist()


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, x``: the statistics of every row of ``docs(doc_id, text)``, and whether labels of it may not be learned."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "x": pa.array([statistics(t) for t in texts_of(batch)], type=pa.list_(pa.float64()))}

    held_out = (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))).alias("held_out")
    return map_batches(docs.select("doc_id", "text", held_out), run, "doc_id bigint, held_out boolean, x array<double>")


@dataclass
class Moments:
    """Number, mean and covariance (of the whole set) of some rows."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def union(parts: list[Moments]) -> Moments:
        n = sum(p.n for p in parts)
        mean = sum(p.n * p.mean for p in parts) / n
        return Moments(n, mean, sum(p.n * (p.cov + np.outer(p.mean - mean, p.mean - mean)) for p in parts) / n)


@dataclass
class Model:
    """Two Gaussians (mean, inverse Cholesky factor, log prior less log determinant), or a constant score."""

    constant: float
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None = None
    pooling: float | None = None
    ridge: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None or not len(x):
            return np.full(len(x), self.constant)
        bad, good = (bias - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, bias in self.classes)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    @staticmethod
    def of(classes: list[Moments], pooling: float, ridge: float) -> Model:
        total = sum(c.n for c in classes)
        pooled = sum(c.n * c.cov for c in classes) / total
        floor = np.diag(np.maximum(np.diag(pooled), LEAST_VARIANCE))
        out = []
        for c in classes:
            factor = np.linalg.cholesky((1 - ridge) * ((1 - pooling) * c.cov + pooling * pooled) + ridge * floor)
            out.append((c.mean, np.linalg.inv(factor), float(np.log(c.n / total) - np.log(np.diag(factor)).sum())))
        return Model(classes[1].n / total, out, pooling, ridge)

    def log_likelihood(self, classes: list[Moments | None]) -> float:
        """Of rows with these moments, up to a constant."""
        out = 0.0
        for (mean, inverse, bias), c in zip(self.classes, classes, strict=True):
            if c:
                spread = c.cov + np.outer(c.mean - mean, c.mean - mean)
                out += c.n * (bias - 0.5 * np.trace(inverse @ spread @ inverse.T))
        return out


def _moments(rows: DataFrame) -> dict[tuple[int, int], Moments]:
    """By (quality, fold); sums of differences from the common mean, so that nothing cancels."""
    d = N_STATS
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    centre = [v or 0.0 for v in rows.agg(*[F.avg(c) for c in x]).first()]
    off = [c - F.lit(m) for c, m in zip(x, centre, strict=True)]
    sums = [F.sum(off[i]).alias(f"s{i}") for i in range(d)] + [F.sum(off[i] * off[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.groupBy("quality", "fold").agg(F.count("*").alias("n"), *sums).collect():
        mean, second = np.array([r[f"s{i}"] for i in range(d)]) / r["n"], np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        out[r["quality"], r["fold"]] = Moments(r["n"], mean + centre, second - np.outer(mean, mean))
    return out


def choose(folds: dict[tuple[int, int], Moments]) -> Model:
    """The model of all folds, with the weights under which each fold is likeliest by the others."""
    of = lambda k, wanted: Moments.union(p) if (p := [m for (q, f), m in folds.items() if q == k and wanted(f)]) else None
    whole = [of(k, lambda f: True) for k in (0, 1)]
    if None in whole:
        total = sum(m.n for m in folds.values())
        return Model((whole[1].n if whole[1] else 0.0) / total if total else 0.5)
    splits = [([of(k, lambda f: f != h) for k in (0, 1)], [of(k, lambda f: f == h) for k in (0, 1)]) for h in range(FOLDS)]
    splits = [(rest, held) for rest, held in splits if None not in rest]
    best = max(((p, r) for p in POOLINGS for r in RIDGES), key=lambda w: sum(Model.of(rest, *w).log_likelihood(held) for rest, held in splits))
    return Model.of(whole, *best)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """The model from ``stats`` of rows that are not held out and ``labels(doc_id, quality)``; only moments by class and fold reach the driver."""
    of_doc = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    rows = stats.where(~F.col("held_out")).join(of_doc, F.col("doc_id") == F.col("labelled"))
    return choose(_moments(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)))))


def scores(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``stats``."""

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array(batch.column("x").to_pylist(), dtype=np.float64).reshape(-1, N_STATS)
        score = model.score(x)
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return map_batches(stats, run, "doc_id bigint, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``labels`` and score every row of ``docs``; each text is read once."""
    stats = materialize(document_statistics(docs), "statistics")
    return scores(stats, fit(stats, labels), threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    model = fit(materialize(document_statistics(docs), "statistics"), labels)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t) for t in texts_of(batch)]).reshape(-1, N_STATS)
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
