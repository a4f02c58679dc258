"""Token counts by a digest cache.

The cache is a Parquet folder ``content_digest, tokenizer_digest, n_tokens`` that is only appended to.
Texts are normalised as far as the tokenizer itself does (where its normalizer makes runs of white space one blank, they become
one blank; otherwise a text is taken as it is), digested, and joined to the cache; only distinct misses are encoded.

Cases: a null text is an empty one (0 bytes, 0 tokens); a text of any length is counted whole; equal texts share one cache
row; rows with equal or null ``doc_id`` each keep their own result row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import materialize, new_path
from .pieces import BATCH_BYTES, Batches, Library
from .words import slices

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"


@lru_cache(maxsize=4)
def _counter(tokenizer_path: str) -> Batches:
    """Token counts by the library the file belongs to; one per worker."""
    if tokenizer_path.endswith(".model"):
        import sentencepiece

        # its pieces may span words: whole texts only
        return Batches(lambda pieces: ([], []), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path).encode, cut=False)
    library = Library(tokenizer_path)
    return Batches(library.pieces, library.whole, library.special, library.cut)


def tokenizer_digest(tokenizer_path: str) -> str:
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _digests(docs: DataFrame, folds_space: bool) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, r"[ \t\r\n]+", " ") if folds_space else text
    return docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"), F.sha2(norm.cast("binary"), 256).alias("content_digest"))


def _cached(docs: DataFrame, cache_path: str, version: str) -> DataFrame | None:
    try:
        cache = docs.sparkSession.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException:  # nothing has been counted yet
        return None
    return cache.where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, cache_path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    ``cache_path`` names a cache to use and to extend; without it a new one is begun in the shared folder.
    """
    path = cache_path or new_path(docs.sparkSession, "token-counts")
    version = tokenizer_digest(tokenizer_path)
    rows = _digests(docs, tokenizer_path.endswith(".json") and Library(tokenizer_path).folds_space)
    # partial aggregation drops copies before the shuffle, however many one text has
    distinct = rows.groupBy("content_digest").agg(F.first("text").alias("text"))
    known = _cached(docs, path, version)
    misses = distinct if known is None else distinct.join(known, "content_digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, texts in slices(batch, most=BATCH_BYTES):
                n = _counter(tokenizer_path).sizes(texts)
                yield pa.RecordBatch.from_pydict({"content_digest": some.column("content_digest"), "tokenizer_digest": pa.array([version] * len(n)), "n_tokens": pa.array(n)})

    misses.mapInArrow(count, CACHE_SCHEMA).write.mode("append").parquet(path)
    counts = _cached(docs, path, version)
    if cache_path:
        # two writers may have counted the same text: one row each; as a table, so that Spark can divide the rows of a text with many copies
        counts = materialize(counts.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    narrow = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "content_digest")
    return narrow.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
