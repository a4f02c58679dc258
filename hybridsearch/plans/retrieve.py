"""The whole chain, for tables of queries: index, search, fuse, rank, deduplicate, hydrate, explain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, enrich, fusion, index, search
from ..operators.relevance import relevance_fallback
from ..sources.files import SearchIndex, load_index, materialize, save_index


def build_index(parents: DataFrame, children: DataFrame, encoder: Callable | None = None) -> SearchIndex:
    """The index of what :func:`corpus.select_index_chunks` gives; a chunk's id is its record's id and window number."""
    chunks = identified(corpus.select_index_chunks(parents, children))
    return index_chunks(chunks, parents, index.encode_text(chunks, encoder))


def identified(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``chunk_id``."""
    window = F.col("window_no") if "window_no" in chunks.columns else F.lit(0)
    return chunks.withColumn("chunk_id", F.concat_ws("#", "standard_id", window))


def index_chunks(chunks: DataFrame, parents: DataFrame, vectors: DataFrame) -> SearchIndex:
    """An index of chunks that have ids and vectors already.  Postings and impacts are written once, for all searches."""
    postings = materialize(index.term_frequencies(chunks), "postings")
    stats = index.stats_of_postings(chunks, postings)
    idf = index.bm25_idf(index.document_frequencies(postings), stats)
    return SearchIndex(chunks, parents, postings, idf, stats, vectors, materialize(search.impacts(postings, stats), "impacts"))


def write_index(chunks: DataFrame, parents: DataFrame, vectors: DataFrame, path: str) -> SearchIndex:
    """The same index, written to ``path`` as it is made: postings once, the statistics and impacts from what was written."""
    spark = chunks.sparkSession
    save_index(SearchIndex(chunks, parents, index.term_frequencies(chunks), None, None, vectors, None), path)
    postings = spark.read.parquet(f"{path}/postings")
    save_index(SearchIndex(None, None, None, None, index.stats_of_postings(spark.read.parquet(f"{path}/chunks"), postings), None, None), path)
    stats = spark.read.parquet(f"{path}/stats")
    save_index(SearchIndex(None, None, None, index.bm25_idf(index.document_frequencies(postings), stats), None, None, search.impacts(postings, stats)), path)
    return load_index(spark, path)


def encode_queries(queries: DataFrame, encoder: Callable | None = None) -> DataFrame:
    """``query_id, embedding`` of ``queries(query_id, query)``, by the encoder of :func:`build_index`."""
    texts = queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text"))
    return index.encode_text(texts, encoder).withColumnRenamed("chunk_id", "query_id")


def retrieve(queries: DataFrame, store: SearchIndex, query_vectors: DataFrame, top_k: int = 5, rerank: bool = False, scorer: Callable | None = None) -> DataFrame:
    """``query_id, rank, standard_id, title, text, page_number`` for the relevant of ``queries(query_id, query)``.

    ``query_vectors(query_id, embedding)`` come from the encoder that made the index.
    """
    asked = relevance_fallback(queries).where("is_relevant")
    dense = search.dense_top_k(query_vectors.join(asked, "query_id", "left_semi"), store.vectors)
    sparse = search.search_impacts(asked, store.impacts, store.idf)
    # few rows a query from here on: kept as tables, so that sizing a join does not search again
    fused = materialize(fusion.rrf_fusion(dense, sparse), "fused")
    candidates = materialize(fusion.part_priority(fusion.build_candidates(fused, store.chunks), asked), "candidates")
    if rerank:
        candidates = fusion.rerank(candidates, asked, store.parents, top_k, scorer)
    return fusion.hydrate_parents(fusion.dedup_results(candidates, top_k), store.parents)


def batch_retrieve(queries: DataFrame, store: SearchIndex, query_vectors: DataFrame, top_k: int = 5, rerank: bool = False) -> DataFrame:
    """One row a query: ``query_id, query, retrieved_standards`` in rank order (empty if rejected) and ``message``."""
    found = retrieve(queries, store, query_vectors, top_k, rerank)
    listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "standard_id"))), lambda x: x["standard_id"]).alias("ids"))
    rows = relevance_fallback(queries).join(listed, "query_id", "left")
    return rows.select("query_id", "query", F.coalesce("ids", F.array().cast("array<string>")).alias("retrieved_standards"), "message")


def recommend(queries: DataFrame, store: SearchIndex, query_vectors: DataFrame, top_k: int = 5, rerank: bool = False, generator: Callable | None = None) -> DataFrame:
    """Results with rationales, in response form; a rejected query keeps one row with its message and no record."""
    found = retrieve(queries, store, query_vectors, top_k, rerank)
    answers = enrich.format_response(enrich.generate_rationales(found, queries, generator))
    rejected = relevance_fallback(queries).where("not is_relevant").select("query_id", "message")
    return answers.withColumn("message", F.lit("")).unionByName(rejected, allowMissingColumns=True)
