"""From raw documents to token digests: five stages, each a table written before the next reads it.

Each stage works on every row of its predecessor and passes on all its columns, whatever their names; the last gives digests.

Cases, in every stage: a null text is an empty one; texts of any length are worked on whole; empty tables stay empty; repeated rows and rows
without ``doc_id`` go through all stages (a row without one is never a near duplicate, and nothing is cut from it), and of
rows that share a ``doc_id`` each is judged by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridsearch.llm import bpe, decontaminate, paragraphs, quality, simhash
from hybridsearch.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from ``labels``, and without labels keeps all."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the least ``doc_id``; a tie goes to the least fingerprint."""
    return simhash.representatives(docs)


def cut_repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each repeated passage only where it occurs first; ``n_chars``, if there is one, follows the text."""
    cut = paragraphs.removed(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; without items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded again; a row a document."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeated_paragraphs),
    ("decontamination", drop_benchmark_leaks),
    ("byte-pair encoding", encode_tokens),
]

#: The stages train a model and search by hashes, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
