"""Readers and writers with explicit schemas: chunks, queries, results and the index."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = "standard_id string, standard_number string, title string, content string, text string, page_number int, category string, source string"
RESULT_SCHEMA = "id string, query string, expected_standards array<string>, retrieved_standards array<string>, latency_seconds double, message string, error string"
DEFAULT_SOURCE = "unknown"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder serves a session on one machine; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.gettempdir()
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_chunks(spark: SparkSession, path: str, source: str = DEFAULT_SOURCE) -> DataFrame:
    """Raw chunks of JSON files, each a top-level array or ``{"chunks": [...]}``: ``seq`` and the chunk columns.

    ``content`` comes before ``text`` and ``standard_id`` before ``standard_number``; ``seq`` is the position in the file.
    """
    files = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_CHUNK.replace(' ', ':').replace(',:', ',')}>>")
    boxed = F.from_json("value", f"chunks array<struct<{_CHUNK.replace(' ', ':').replace(',:', ',')}>>")["chunks"]
    chunks = F.when(F.ltrim("value").startswith("["), listed).otherwise(boxed)
    rows = files.select(F.posexplode(chunks).alias("seq", "c"))
    first = lambda *names: F.coalesce(*[F.col(f"c.{n}") for n in names])
    return rows.select(
        F.col("seq").cast("bigint").alias("seq"), F.coalesce(first("standard_id", "standard_number"), F.lit("")).alias("standard_id"), F.coalesce("c.title", F.lit("")).alias("title"),
        F.coalesce(first("content", "text"), F.lit("")).alias("text"), F.col("c.page_number").alias("page_number"),
        F.coalesce("c.category", F.lit("")).alias("category"), F.coalesce("c.source", F.lit(source)).alias("source"),
    )


def write_chunks(parents: DataFrame, children: DataFrame, path: str) -> None:
    """Parents and children as two Parquet folders."""
    parents.write.mode("overwrite").parquet(f"{path}/parents")
    children.write.mode("overwrite").parquet(f"{path}/children")


def load_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/parents"), spark.read.parquet(f"{path}/children")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``seq, query_id, query, expected_standards`` of a JSON array of queries; a missing id is ``Q-`` and the position, at least three digits."""
    kinds = "array<struct<id:string,query:string,expected_standards:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kinds)).alias("seq", "q"))
    return rows.select(
        F.col("seq").cast("bigint").alias("seq"), F.coalesce("q.id", F.format_string("Q-%03d", F.col("seq"))).alias("query_id"),
        F.coalesce("q.query", F.lit("")).alias("query"), F.coalesce("q.expected_standards", F.array().cast("array<string>")).alias("expected_standards"),
    )


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, in the order of ``seq``."""
    results.orderBy("seq").drop("seq").write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_SCHEMA).json(path)


@dataclass
class SearchIndex:
    """A search index: plain tables.  ``impacts`` are the postings as searches read them, by blocks of chunks."""

    chunks: DataFrame
    parents: DataFrame
    postings: DataFrame
    idf: DataFrame
    stats: DataFrame
    vectors: DataFrame
    impacts: DataFrame


def save_index(index: SearchIndex, path: str) -> None:
    """Write an index as Parquet; tables that are None are left as they are in ``path``."""
    for f in fields(index):
        if (table := getattr(index, f.name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{f.name}")


def load_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(SearchIndex)})
