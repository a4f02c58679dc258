"""One registered query an operator: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import relevance as R
from ..functions import text as T
from ..operators import corpus, dictionary, enrich, evaluate, fusion, index, search
from ..operators import relevance as relevance_ops
from ..sources import files
from ..streaming.recommend import recommend_stream as start_stream
from . import retrieve as plans
from . import views

QUERIES = {}
#: Bytes of texts, with a thousand a row for the rest, beyond which a JSON file of chunks takes no more rows.
FILE_BYTES = 8 << 20


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks for the index statistics."""
    return _docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.normalize_records(views.chunks_raw(spark, sf))


def _dictionary(spark: SparkSession) -> DataFrame:
    return dictionary.read_dictionary(views.dictionary_sections(spark))


def _digest(name: str):
    """MD5 of a text, to compare whole texts by."""
    return F.md5(F.col(name).cast("binary"))


# sources and sinks


@_query
def pages_to_lines(spark, sf):
    return corpus.pages_to_lines(views.pages(spark, sf)).select("doc_id", F.col("page_line").cast("bigint").alias("page_line"), "text")


@_query
def read_chunks(spark, sf):
    """Raw chunks written as one JSON array a file, read back."""
    path = files.shared_path(spark, "chunks-json")
    raw = views.chunks_raw(spark, sf).withColumnRenamed("text", "content")
    # a file takes a block of a thousand ids, divided where its rows are long or many
    block, order = F.floor(F.col("seq") / 1000), Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint") + F.lit(1000)
    placed = raw.withColumn("file", block).withColumn("part", F.floor(F.coalesce(F.sum(size).over(order), F.lit(0)) / FILE_BYTES))
    packed = placed.groupBy("file", "part").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "standard_id", "title", "content", "page_number", "category", "source")))).alias("value"))
    boxed = F.when((F.col("file") + F.col("part")) % 2 == 0, F.col("value")).otherwise(F.concat(F.lit('{"chunks":'), "value", F.lit("}")))
    packed.select(boxed.alias("value"), "file", "part").write.option("lineSep", "\n").partitionBy("file", "part").text(path)
    return files.read_chunks(spark, f"{path}/*/*/*.txt").select("standard_id", "title", _digest("text").alias("text_md5"), "page_number", "category", "source")


@_query
def write_chunks(spark, sf):
    path = files.shared_path(spark, "chunks")
    files.write_chunks(*corpus.prepare_corpus(views.chunks_raw(spark, sf)), path)
    parents, children = files.load_chunks(spark, path)
    count = children.groupBy("standard_id").agg(F.count("*").alias("n_children"))
    return parents.join(count, "standard_id", "left").select("standard_id", "title", _digest("text").alias("text_md5"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


@_query
def read_queries(spark, sf):
    path = files.shared_path(spark, "queries-json")
    rows = views.queries(spark, sf).select(F.col("query_id").alias("id"), "query")
    # files of about a thousand queries, whatever their number
    block = F.pmod(F.xxhash64("id"), F.lit(1 + rows.count() // 1000))
    rows.groupBy(block.alias("b")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "query")))).alias("value")).select("value", "b").write.partitionBy("b").text(path)
    return files.read_queries(spark, f"{path}/*/*.txt").select("query_id", "query")


@_query
def write_results(spark, sf):
    path = files.shared_path(spark, "results")
    rows = views.results(spark, sf).select("seq", F.col("query_id").alias("id"), F.lit("").alias("query"), "expected_standards", "retrieved_standards", "latency_seconds")
    files.write_results(rows, path)
    back = files.read_results(spark, path)
    return back.select("id", F.array_join("expected_standards", "|").alias("expected"), F.array_join("retrieved_standards", "|").alias("retrieved"), F.round("latency_seconds", 8).alias("latency"))


@_query
def build_index(spark, sf):
    path = files.shared_path(spark, "index")
    parents, children = corpus.prepare_corpus(views.chunks_raw(spark, sf))
    chunks = plans.identified(corpus.select_index_chunks(parents, children))
    store = plans.write_index(chunks, parents, index.encode_text(chunks), path)
    return store.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).join(store.idf.select("term", F.round("idf", 6).alias("idf")), "term")


@_query
def read_dictionary(spark, sf):
    """Which dictionary entries occur in the documents, and in how many."""
    entries = dictionary.read_dictionary(views.dictionary_sections(spark))
    words = _docs(spark, sf).select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("key"))
    return entries.join(words.groupBy("key").agg(F.count("*").alias("n_docs")), "key", "left").select("kind", "key", "value", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


# projections and predicates


@_query
def normalize_standard_id(spark, sf):
    return views.chunks_raw(spark, sf).select("seq", T.normalize_standard_id(F.col("standard_id")).alias("standard_id"))


@_query
def is_toc_title(spark, sf):
    return views.chunks_raw(spark, sf).select("seq", T.is_toc_title(F.col("title")).alias("is_toc"))


@_query
def clean_title_suffix(spark, sf):
    return views.chunks_raw(spark, sf).select("seq", T.clean_title_suffix(F.col("title")).alias("title"))


@_query
def detect_headings(spark, sf):
    return corpus.detect_headings(views.lines(spark, sf)).select("doc_id", "line_no", "raw_id", F.col("id_start").cast("bigint").alias("id_start"), "is_heading")


@_query
def filter_min_content(spark, sf):
    return corpus.filter_min_content(_docs(spark, sf)).select("doc_id", "n_chars")


@_query
def split_sentences(spark, sf):
    rows = _docs(spark, sf).select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.posexplode("s").alias("sentence_no", "sentence")).select("doc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), "sentence")


@_query
def context_prefix(spark, sf):
    return views.chunks_raw(spark, sf).select("seq", T.context_prefix(F.col("standard_id"), F.col("title"), F.col("category")).alias("prefix"))


@_query
def tokenize(spark, sf):
    rows = _docs(spark, sf).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@_query
def extract_part_number(spark, sf):
    return _records(spark, sf).select("seq", T.extract_part_number(F.col("standard_id")).alias("part"))


@_query
def extract_query_part(spark, sf):
    return views.queries(spark, sf).select("query_id", T.extract_query_part(F.col("query")).alias("part"))


@_query
def normalize_eval_id(spark, sf):
    return views.result_rows(spark, sf).select("seq", "rank", T.normalize_eval_id(F.col("retrieved")).alias("id"))


# corpus building


@_query
def segment_lines(spark, sf):
    return corpus.segment_lines(views.lines(spark, sf)).select("doc_id", "seq", "standard_id", "title", "text", "page_number")


@_query
def dedup_keep_longest(spark, sf):
    return corpus.dedup_keep_longest(_records(spark, sf)).select("standard_id", "seq", "first_seq", "title", _digest("text").alias("text_md5"))


@_query
def dedup_report(spark, sf):
    return corpus.dedup_report(_records(spark, sf))


@_query
def create_child_chunks(spark, sf):
    return corpus.create_child_chunks(_records(spark, sf)).select("seq", F.col("window_no").cast("bigint").alias("window_no"), "text")


@_query
def prepare_corpus(spark, sf):
    parents, children = corpus.prepare_corpus(views.chunks_raw(spark, sf))
    return children.select("standard_id", F.col("window_no").cast("bigint").alias("window_no"), "title", "category", "page_number", "raw_window")


@_query
def select_index_chunks(spark, sf):
    chosen = corpus.select_index_chunks(*corpus.prepare_corpus(views.chunks_raw(spark, sf)))
    return chosen.groupBy("standard_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# query preparation


def _flag(name, f):
    def query(spark, sf):
        return views.queries(spark, sf).select("query_id", f(F.col("query")).alias("value"))

    QUERIES[name] = query


for _name, _f in {
    "normalize_query": R.normalize_query, "is_greeting": R.is_greeting, "is_mixed_language": R.is_mixed_language, "has_standard_number": lambda c: R.has_standard_number(R.normalize_query(c)),
    "has_domain_hint": R.has_domain_hint, "add_query_prefix": R.add_query_prefix,
}.items():
    _flag(_name, _f)


@_query
def fix_spellings(spark, sf):
    return dictionary.fix_spellings(views.queries(spark, sf), _dictionary(spark), "query", "value").select("query_id", "value")


@_query
def expand_abbreviations(spark, sf):
    return dictionary.expand_abbreviations(views.queries(spark, sf), _dictionary(spark), "query", "value").select("query_id", "value")


@_query
def classify_queries(spark, sf):
    rows = relevance_ops.classify_queries(views.queries(spark, sf), _dictionary(spark))
    return rows.select("query_id", "is_relevant", "reason", "primary_query", "expanded_query", "has_expansions", "message")


@_query
def relevance_fallback(spark, sf):
    return relevance_ops.relevance_fallback(views.queries(spark, sf)).select("query_id", "is_relevant", "search_query", "message")


EXPANSION_RESPONSE = """CASE length(query) % 5
  WHEN 0 THEN '```json {"relevant": true, "expanded_query": "more", "message": ""}```' WHEN 1 THEN '{"relevant": false, "message": "no"}'
  WHEN 2 THEN 'no json' WHEN 3 THEN '{"expanded_query": ""}' ELSE '{"relevant": false}' END"""


@_query
def parse_expansion_response(spark, sf):
    rows = views.queries(spark, sf).withColumn("response", F.expr(EXPANSION_RESPONSE))
    return relevance_ops.parse_expansion_response(rows).select("query_id", "is_relevant", "search_query", "message")


# index statistics


@_query
def term_frequencies(spark, sf):
    return index.term_frequencies(_chunks(spark, sf))


@_query
def document_frequencies(spark, sf):
    return index.document_frequencies(index.term_frequencies(_chunks(spark, sf)))


@_query
def corpus_stats(spark, sf):
    return index.corpus_stats(_chunks(spark, sf)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@_query
def bm25_idf(spark, sf):
    chunks = _chunks(spark, sf)
    # the texts are tokenised once, for the frequencies and their mean
    postings = files.materialize(index.term_frequencies(chunks), "postings")
    rows = index.bm25_idf(index.document_frequencies(postings), index.stats_of_postings(chunks, postings))
    return rows.select("term", "df", F.round("idf", 6).alias("idf"))


@_query
def encode_text(spark, sf):
    rows = index.encode_text(_chunks(spark, sf)).select("chunk_id", F.posexplode("embedding").alias("dim", "x"))
    return rows.where("x <> 0").select("chunk_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


# retrieval


def _search_input(spark, sf):
    chunks = _chunks(spark, sf)
    # the statistics read the postings, which are tokenised once
    postings = files.materialize(index.term_frequencies(chunks), "postings")
    stats = files.materialize(index.stats_of_postings(chunks, postings), "stats")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.concat(F.lit("B-"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("search_query"))
    return asked, postings, index.bm25_idf(index.document_frequencies(postings), stats), stats


@_query
def bm25_scores(spark, sf):
    return search.bm25_scores(*_search_input(spark, sf)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@_query
def sparse_top_k(spark, sf):
    return search.sparse_top_k(*_search_input(spark, sf)).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@_query
def dense_top_k(spark, sf):
    """Every vector whose id is divisible by 100, against all vectors."""
    vectors = views.vectors(spark, sf)
    asked = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return search.dense_top_k(asked, vectors).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@_query
def l2_normalize(spark, sf):
    rows = views.vectors(spark, sf).select("chunk_id", F.posexplode(index.l2_normalize(F.col("embedding"))).alias("dim", "x"))
    return rows.select("chunk_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


_STORES: dict[tuple[str, str], str] = {}


def _version(spark: SparkSession, sf: str) -> str:
    """A digest of the listing of ``documents``: paths, sizes and times of its files.  Their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{sf}/documents.parquet").select("path", "length", "modificationTime")
    one = F.md5(F.to_json(F.struct("path", "length", F.col("modificationTime").cast("double"))).cast("binary"))
    # a sum of digests, so that no task gathers the listing
    parts = [F.sum(F.conv(F.substring(one, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    return ",".join(map(str, found.agg(F.count("*"), *parts).first()))


def search_index(spark: SparkSession, sf: str):
    """The index of all records, each with the vector of its text; made once a session and state of the tables' files."""
    key = (spark.sparkContext.applicationId, f"{sf} {_version(spark, sf)}")
    if key in _STORES:
        try:
            return files.load_index(spark, _STORES[key])
        except AnalysisException:  # its folder has gone
            del _STORES[key]
    records = files.materialize(_records(spark, sf), "records")
    chunks, path = records.withColumn("chunk_id", F.col("seq")), files.shared_path(spark, "index")
    store = plans.write_index(chunks, corpus.dedup_keep_longest(records), index.encode_text(chunks.select("chunk_id", "text")), path)
    _STORES[key] = path
    return store


def _asked(spark, sf):
    return views.queries(spark, sf)


def _query_vectors(spark, sf):
    return plans.encode_queries(_asked(spark, sf))


def _fused(spark, sf):
    store, asked = search_index(spark, sf), relevance_ops.relevance_fallback(_asked(spark, sf)).where("is_relevant")
    dense = search.dense_top_k(_query_vectors(spark, sf).join(asked, "query_id", "left_semi"), store.vectors)
    return store, asked, files.materialize(fusion.rrf_fusion(dense, search.search_impacts(asked, store.impacts, store.idf)), "fused")


@_query
def rrf_fusion(spark, sf):
    return _fused(spark, sf)[2].select("query_id", "chunk_id", F.col("rrf_rank").cast("bigint").alias("rrf_rank"), F.round("rrf_score", 6).alias("rrf_score"))


def _candidates(spark, sf):
    store, asked, fused = _fused(spark, sf)
    return store, asked, fusion.build_candidates(fused, store.chunks)


@_query
def build_candidates(spark, sf):
    return _candidates(spark, sf)[2].select("query_id", "chunk_id", F.col("rrf_rank").cast("bigint").alias("rrf_rank"), "standard_id", "title", "page_number", "part_number")


def _prioritised(spark, sf):
    store, asked, candidates = _candidates(spark, sf)
    return store, asked, files.materialize(fusion.part_priority(candidates, asked), "candidates")


def _ranked(df):
    return df.select("query_id", "chunk_id", "standard_id", F.col("rank").cast("bigint").alias("rank"))


@_query
def part_priority(spark, sf):
    return _ranked(_prioritised(spark, sf)[2])


@_query
def rerank(spark, sf):
    store, asked, candidates = _prioritised(spark, sf)
    return _ranked(fusion.rerank(candidates, asked, store.parents))


@_query
def dedup_results(spark, sf):
    return _ranked(fusion.dedup_results(_prioritised(spark, sf)[2]))


def _found(df):
    return df.select("query_id", F.col("rank").cast("bigint").alias("rank"), "standard_id", "title", _digest("text").alias("text_md5"), "page_number")


@_query
def hydrate_parents(spark, sf):
    store, _, candidates = _prioritised(spark, sf)
    return _found(fusion.hydrate_parents(fusion.dedup_results(candidates), store.parents))


@_query
def retrieve(spark, sf):
    return _found(plans.retrieve(_asked(spark, sf), search_index(spark, sf), _query_vectors(spark, sf)))


@_query
def batch_retrieve(spark, sf):
    rows = plans.batch_retrieve(_asked(spark, sf), search_index(spark, sf), _query_vectors(spark, sf))
    return rows.select("query_id", F.array_join("retrieved_standards", "|").alias("retrieved"), "message")


@_query
def recommend_stream(spark, sf):
    """The queries written as files, streamed through the index, and the sink read back."""
    source, sink, marks = (files.shared_path(spark, x) for x in ("stream-in", "stream-out", "stream-marks"))
    _asked(spark, sf).write.json(source)
    start_stream(spark, source, sink, marks, search_index(spark, sf), plans.encode_queries).awaitTermination()
    return spark.read.parquet(sink).select("query_id", F.array_join("retrieved_standards", "|").alias("retrieved"), "message")


# enrichment


def _results(spark, sf):
    return files.materialize(plans.retrieve(_asked(spark, sf), search_index(spark, sf), _query_vectors(spark, sf)), "results")


@_query
def fallback_rationale(spark, sf):
    return views.chunks_raw(spark, sf).select("seq", enrich.fallback_rationale(F.col("standard_id"), F.col("title"), F.col("text")).alias("rationale"))


@_query
def standards_block(spark, sf):
    return enrich.standards_block(_results(spark, sf))


@_query
def build_prompts(spark, sf):
    return enrich.build_prompts(_results(spark, sf), _asked(spark, sf))


RATIONALE_RESPONSE = """CASE seq % 4
  WHEN 0 THEN '```json [{"standard_id": "A", "rationale": "r' || CAST(seq AS STRING) || '"}, {"standard_id": "A", "rationale": "later"}]```'
  WHEN 1 THEN 'no json' WHEN 2 THEN '[{"standard_id": "B"}]' ELSE '[{"standard_id": "B", "rationale": "' || category || '"}]' END"""


@_query
def parse_rationale_response(spark, sf):
    rows = views.chunks_raw(spark, sf).select(F.col("seq").alias("query_id"), F.expr(RATIONALE_RESPONSE).alias("response"))
    parsed = enrich.parse_rationale_response(rows)
    listed = F.array_sort(F.transform(F.map_entries("rationales"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return parsed.select("query_id", "is_valid", F.array_join(listed, "|").alias("rationales"))


def _answers(results: DataFrame) -> DataFrame:
    """Made-up answers that name each query's first result; none for every other query."""
    answer = F.concat(F.lit('```json\n[{"standard_id": "'), "standard_id", F.lit('", "rationale": "because"}]\n```'))
    return results.where("rank = 1").select("query_id", F.when(F.ascii(F.right("query_id", F.lit(1))) % 2 == 0, answer).otherwise("none").alias("response"))


@_query
def merge_rationales(spark, sf):
    results = _results(spark, sf)
    rows = enrich.merge_rationales(results, enrich.parse_rationale_response(_answers(results)))
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "standard_id", "rationale")


@_query
def generate_rationales(spark, sf):
    rows = enrich.generate_rationales(_results(spark, sf), _asked(spark, sf))
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "standard_id", "rationale")


@_query
def format_response(spark, sf):
    rows = enrich.format_response(enrich.generate_rationales(_results(spark, sf), _asked(spark, sf)))
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "standard_id", "title", "page_number", "rationale")


@_query
def recommend(spark, sf):
    rows = plans.recommend(_asked(spark, sf), search_index(spark, sf), _query_vectors(spark, sf))
    return rows.select("query_id", F.col("rank").cast("bigint").alias("rank"), "standard_id", "title", "page_number", "rationale", "message")


# evaluation


@_query
def golden_set(spark, sf):
    """Retrieval for benchmark items, measured: expected are the ids of records that hold the item's text."""
    store, asked = search_index(spark, sf), _asked(spark, sf).where("query_id LIKE 'B-%'")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.concat(F.lit("B-"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("item"))
    # an item is looked for where its longest word is
    words = items.select("query_id", "item", F.explode(F.array_distinct(T.tokenize(F.col("item")))).alias("term")).groupBy("query_id", "item").agg(F.max_by("term", F.struct(F.length("term"), "term")).alias("term"))
    holds = store.postings.join(words, "term").join(store.chunks.select("chunk_id", "standard_id", "text"), "chunk_id").where(F.contains("text", F.col("item")))
    expected = holds.groupBy("query_id").agg(F.array_sort(F.collect_set("standard_id")).alias("expected_standards"))
    found = plans.batch_retrieve(asked, store, _query_vectors(spark, sf)).join(expected, "query_id").withColumn("latency_seconds", F.lit(0.0))
    return evaluate.evaluate(found).select("total", *[F.round(c, 6).alias(c) for c in ("hit_rate_3", "mrr_5")])


@_query
def hit_at_k(spark, sf):
    return views.results(spark, sf).select("query_id", evaluate.hit_at_k(F.col("retrieved_standards"), F.col("expected_standards")).alias("hit"))


@_query
def reciprocal_rank(spark, sf):
    return views.results(spark, sf).select("query_id", F.round(evaluate.reciprocal_rank(F.col("retrieved_standards"), F.col("expected_standards")), 6).alias("rr"))


def _metrics(spark, sf):
    return evaluate.evaluate(views.results(spark, sf))


@_query
def evaluate_results(spark, sf):
    return _metrics(spark, sf).select("total", *[F.round(c, 6).alias(c) for c in ("hit_rate_3", "mrr_5", "avg_latency")])


@_query
def latency_summary(spark, sf):
    return evaluate.latency_summary(views.results(spark, sf))


@_query
def meets_targets(spark, sf):
    return evaluate.meets_targets(_metrics(spark, sf))
