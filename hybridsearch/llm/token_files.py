"""Token files: token ids as Parquet list columns, in document order, with metadata columns beside them.

A file holds ``doc_id, part, seq, n_tokens, before, tokens``.  ``part`` numbers the range partitions of
``doc_id`` in ascending order, ``seq`` the rows within a part, ``before`` counts the ids of the part's
earlier rows.  Row groups and pages are kept small and dictionary-encoded, so a reader can select
documents by ``doc_id`` statistics and page indexes, and metadata without touching the ids.

Cases: a null text is an empty one (only the end id is written); a text of any length is encoded whole, in one row; rows with equal
``doc_id`` stay, in the order of their texts' hashes; a null ``doc_id`` sorts first; an empty table gives an empty folder that
reads back as no rows; further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path
from .pieces import BATCH_BYTES, Batches, Library
from .words import slices

FILE_SCHEMA = "doc_id bigint, part int, seq bigint, n_tokens bigint, before bigint, tokens array<int>"


@lru_cache(maxsize=4)
def library_encoder(tokenizer_path: str) -> Batches:
    """Ids by the tokenizers library; one per worker."""
    library = Library(tokenizer_path)
    return Batches(library.pieces, library.whole, library.special, library.cut)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode every text of ``docs(doc_id, text)`` and write the ids in ascending ``doc_id`` order."""
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some, texts in slices(batch, most=BATCH_BYTES):
                first, own = library_encoder(tokenizer_path).ids(texts)
                n = np.diff(first) + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                ids = np.full(offsets[-1], end_id, dtype=np.int32)
                ids[np.arange(len(own)) + np.repeat(np.arange(len(n)), n - 1)] = own
                yield pa.RecordBatch.from_pydict({
                    "doc_id": some.column("doc_id"),
                    "part": pa.array(np.full(len(n), part, dtype=np.int32)),
                    "seq": pa.array(seq + np.arange(len(n), dtype=np.int64)),
                    "n_tokens": pa.array(n),
                    "before": pa.array(before + offsets[:-1]),
                    "tokens": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                })
                seq, before = seq + len(n), before + int(offsets[-1])

    (
        ordered.mapInArrow(run, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' columns and ``start``: the ids of all documents before a row's."""
    from pyspark.sql import Window

    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row per part, so the window and the broadcast are bounded by the number of files
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    bases = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before"))


def id_checksums(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows as read_token_files() gives them."""

    def crc(batch: pa.RecordBatch) -> dict:
        lists = batch.column("tokens")
        offsets = lists.offsets.to_numpy()
        ids = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).view(np.uint8)
        sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(sums, type=pa.int64())}

    return map_batches(rows.select("doc_id", "start", "n_tokens", "tokens"), crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write token files to the shared folder, read them back, and return each document's digest row."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return id_checksums(read_token_files(docs.sparkSession, path))
