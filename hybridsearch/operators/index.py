"""Index statistics for BM25, and a default text encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize

#: Share of the mean inverse document frequency that stands in for negative ones.
EPSILON = 0.25
DIM = 64


def _tokens(text: str = "text") -> Column:
    return tokenize(F.coalesce(text, F.lit("")))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, wherever the optimizer moves it: a one-element list binds it."""
    return F.get(F.transform(F.array(value), f), 0)


def _runs(values: Column, value: str, count: str) -> Column:
    """``value`` and ``count`` of every run of equal values in an array, sorted before, so that they are counted within their row."""

    def counted(values: Column) -> Column:
        places = F.transform(values, lambda _, i: i)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1)))
        run = lambda starts: lambda i, j: F.struct(F.get(values, i).alias(value), (F.coalesce(F.get(starts, j + 1), F.size(values)) - i).alias(count))
        return _bound(starts, lambda starts: F.transform(starts, run(starts)))

    return _bound(F.sort_array(values), counted)


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """``chunk_id, term, tf, dl`` of ``chunks(chunk_id, text)``, an id a row; ``dl`` is the chunk's length in tokens.

    A row's sorted tokens are counted in runs, so nothing is shuffled.
    """
    rows = chunks.select("chunk_id", _tokens().alias("tokens"))
    terms = rows.select("chunk_id", F.size("tokens").cast("bigint").alias("dl"), F.explode(_runs(F.col("tokens"), "term", "tf")).alias("run"))
    return terms.select("chunk_id", F.col("run.term").alias("term"), F.col("run.tf").cast("bigint").alias("tf"), "dl")


def document_frequencies(postings: DataFrame) -> DataFrame:
    """``term, df``."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row ``n_docs, avgdl``; empty chunks count."""
    return _stats(chunks.agg(F.count("*").alias("n_docs"), F.sum(F.size(_tokens())).alias("n_tokens")))


def stats_of_postings(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """The same of chunks whose postings exist already, without taking their texts apart again."""
    # single rows
    return _stats(chunks.agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(postings.agg(F.sum("tf").alias("n_tokens")))))


def _stats(counts: DataFrame) -> DataFrame:
    return counts.select("n_docs", F.coalesce(F.try_divide("n_tokens", "n_docs"), F.lit(0.0)).cast("double").alias("avgdl"))


def bm25_idf(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf``; a negative idf becomes a quarter of the mean over all terms, taken before."""
    one = F.broadcast(stats)  # a single row
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    rows = frequencies.crossJoin(one).select("term", "df", raw.alias("raw"))
    mean = F.broadcast(rows.agg(F.avg("raw").alias("mean")))  # a single row
    return rows.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def hash_encode(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """``chunk_id, embedding``: L2-normalised token counts in ``dim`` slots by the tokens' digests; the default encoder, without a model.

    A batch's distinct tokens are digested once; counts are whole numbers, so their order changes no length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            coded = lists.flatten().dictionary_encode()
            slot = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % dim for t in coded.dictionary.to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            n = np.bincount(row * dim + slot[coded.indices.to_numpy()], minlength=len(lists) * dim).reshape(-1, dim).astype(np.float64)
            n /= np.maximum(np.sqrt((n * n).sum(axis=1, keepdims=True)), 1e-9)
            ends = pa.array(np.arange(len(lists) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.ListArray.from_arrays(ends, pa.array(n.ravel()))], names=["chunk_id", "embedding"])

    chunk_id = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", _tokens().alias("tokens")).mapInArrow(run, f"chunk_id {chunk_id}, embedding array<double>")


def l2_normalize(vector: Column) -> Column:
    """A vector divided by its length, or by 1e-9 if that is larger."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return _bound(F.greatest(norm, F.lit(1e-9)), lambda n: F.transform(vector, lambda x: x.cast("double") / n))


def encode_text(chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], list]] | None = None, batch: int = 64) -> DataFrame:
    """``chunk_id, embedding`` of ``chunks(chunk_id, text)``.

    ``encoder`` makes a function from a list of texts to one vector each (of three-dimensional output the first
    token's vector); it is made once a task.  Without one, tokens are hashed.
    """
    if encoder is None:
        return hash_encode(chunks)

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        encode = encoder()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                out = np.asarray(encode(part["text"].fillna("").tolist()), dtype=np.float64)
                out = out[:, 0, :] if out.ndim == 3 else out
                out = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": list(out)})

    chunk_id = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {chunk_id}, embedding array<double>")
