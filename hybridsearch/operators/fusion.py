"""From ranked lists to results: fusion, candidates, part order, re-ranking, deduplication, hydration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_part_number, extract_query_part, tokenize

RRF_K, CANDIDATES = 60, 10
#: Sides are sent to every task up to so many bytes, and joined by a shuffle otherwise.
BROADCAST_BYTES = 128 << 20


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if its texts and other values, counted now, are within BROADCAST_BYTES."""
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def rrf_fusion(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """``query_id, chunk_id, rrf_score, rrf_rank`` of two lists ``query_id, chunk_id, rank``.

    Equal scores go in dense order, then in sparse order.
    """
    lists = dense.select("query_id", "chunk_id", F.col("rank").alias("dense"), F.lit(None).cast("int").alias("sparse")).unionByName(
        sparse.select("query_id", "chunk_id", F.lit(None).cast("int").alias("dense"), F.col("rank").alias("sparse"))
    )
    both = lists.groupBy("query_id", "chunk_id").agg(F.min("dense").alias("dense"), F.min("sparse").alias("sparse"))
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf_score", share("dense") + share("sparse"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), F.col("dense").asc_nulls_last(), F.col("sparse").asc_nulls_last())
    return scored.select("query_id", "chunk_id", "rrf_score", F.row_number().over(order).alias("rrf_rank"))


def build_candidates(fused: DataFrame, chunks: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """The first n of each fused list with the chunks' columns and the part that the record id names."""
    first = fused.where(F.col("rrf_rank") <= n)
    return chunks.join(_small(first), "chunk_id").withColumn("part_number", extract_part_number(F.col("standard_id")))


def part_priority(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``candidates`` with ``rank``: if the raw query names a part, its part comes first, then none, then others; else as fused."""
    asked = _small(queries.select("query_id", extract_query_part(F.col("query")).alias("query_part")))
    part, want = F.col("part_number"), F.col("query_part")
    bucket = F.when(want.isNull() | (part == want), 0).when(part.isNull(), 1).otherwise(2)
    order = Window.partitionBy("query_id").orderBy("bucket", "rrf_rank")
    return candidates.join(asked, "query_id").withColumn("bucket", bucket).withColumn("rank", F.row_number().over(order)).drop("query_part")


def token_overlap(query: Column, passage: Column) -> Column:
    """The share of a query's distinct tokens that a passage has: the default scorer."""
    return _share(F.array_distinct(tokenize(query)), tokenize(passage))


def _share(own: Column, tokens: Column) -> Column:
    """The share of distinct tokens ``own`` that are among ``tokens``; only the few of a query are put in a set."""
    return F.coalesce(F.size(F.array_intersect(tokens, own)) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0)).cast("double")


def rerank(
    candidates: DataFrame, queries: DataFrame, parents: DataFrame | None = None, top_k: int = 5,
    scorer: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None, passthrough: bool = False,
) -> DataFrame:
    """``candidates`` with a new ``rank`` by a scorer of (query, passage), the first ``2 * top_k`` of them.

    Passages are the parents' texts, or the chunks' own where there is none.  ``scorer`` makes a function from queries and
    passages to scores, once a task; without one token overlap scores.  ``passthrough`` keeps the order.
    """
    order = Window.partitionBy("query_id")
    if not passthrough:
        rows = candidates.join(_small(queries.select("query_id", F.col("query").alias("asked"))), "query_id")
        passage = F.col("text")
        if parents is not None:
            own = parents.select("standard_id", F.col("text").alias("parent_text")).dropDuplicates(["standard_id"])
            if scorer is None:
                # a parent is taken apart once, not for each of its candidates
                own = own.select("standard_id", F.array_distinct(tokenize(F.col("parent_text"))).alias("parent_text"))
                passage = F.coalesce("parent_text", tokenize(F.col("text")))
            else:
                passage = F.coalesce("parent_text", "text")
            rows = own.join(_small(rows), "standard_id", "right")
        elif scorer is None:
            passage = tokenize(passage)
        rows = rows.withColumn("passage", passage)
        if scorer is None:
            rows = rows.withColumn("rerank_score", _share(F.array_distinct(tokenize(F.col("asked"))), F.col("passage")))
        else:

            @F.pandas_udf("double")
            def scored(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
                score = scorer()
                for asked, passages in pairs:
                    yield pd.Series(score(asked.tolist(), passages.tolist()), dtype="float64")

            rows = rows.withColumn("rerank_score", scored("asked", "passage"))
        candidates = rows.withColumn("new_rank", F.row_number().over(order.orderBy(F.round("rerank_score", 9).desc(), "rank")))
        candidates = candidates.drop("rank", "asked", "passage", "parent_text").withColumnRenamed("new_rank", "rank")
    return candidates.where(F.col("rank") <= 2 * top_k)


def dedup_results(candidates: DataFrame, top_k: int = 5) -> DataFrame:
    """The best-ranked chunk of each (query, record id), then the first top_k, ranked anew."""
    own = [c for c in candidates.columns if c not in ("query_id", "standard_id", "rank")]
    best = candidates.groupBy("query_id", "standard_id").agg(F.min_by(F.struct("rank", *own), "rank").alias("b"))
    order = Window.partitionBy("query_id").orderBy("b.rank")
    ranked = best.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_k)
    return ranked.select("query_id", "standard_id", *[F.col(f"b.{c}").alias(c) for c in own], F.col("new_rank").alias("rank"))


def hydrate_parents(results: DataFrame, parents: DataFrame) -> DataFrame:
    """``query_id, rank, standard_id, title, text, page_number`` from the parent, or the chunk where there is none.

    The few results go to the wide parents, not the other way round.
    """
    own = parents.select("standard_id", F.struct("title", "text", "page_number").alias("parent"))
    joined = own.join(_small(results), "standard_id", "right")
    pick = lambda c: F.when(F.col("parent").isNotNull(), F.col(f"parent.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("query_id", "rank", "standard_id", pick("title"), pick("text"), pick("page_number"))
