"""Inputs that the queries derive from the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_T = "CAST({} AS STRING)".format
_K, _Y = _T("(doc_id % 150 + 100)"), _T("(1970 + (doc_id % 150 + 100) % 30)")
_ROMAN = "split_part('I,II,III,IV,V,VI,VII,VIII,IX,X,XI,XII', ',', CAST((doc_id % 150 + 100) % 12 + 1 AS INT))"
_TITLE = f"source || ' ' || lang || ' ' || {_T('(doc_id % 20)')} || '.' || {_T('(doc_id % 9)')}"

#: Raw chunks: 150 ids in five spellings, titles with page numbers, some like tables of contents.
CHUNKS_RAW = f"""
SELECT doc_id AS seq,
  CASE doc_id % 5
    WHEN 0 THEN 'IS ' || {_K} || ': ' || {_Y}
    WHEN 1 THEN 'IS' || {_K} || ':' || {_Y}
    WHEN 2 THEN 'IS ' || {_K} || '(PART ' || {_ROMAN} || '):' || {_Y}
    WHEN 3 THEN '  IS  ' || {_K} || ' (Part 2/ SEC iv) : ' || {_Y}
    ELSE 'IS ' || {_K} || ' ( part 3 ): ' || {_Y} END AS standard_id,
  CASE WHEN doc_id % 17 = 0 THEN repeat({_TITLE} || ' ', 20) WHEN doc_id % 13 = 0 THEN '1.2 IS 45 ' || {_TITLE} ELSE {_TITLE} END AS title,
  text, CAST(doc_id % 300 AS INT) AS page_number, CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS category, source
FROM documents"""

#: Queries: benchmark texts and users' turns, with words that make some relevant, name parts or greet.
QUERIES = f"""
SELECT 'B-' || {_T('item_id')} AS query_id,
  CASE item_id % 4 WHEN 0 THEN 'cement ' || text WHEN 1 THEN 'Standard ' || text || ' part 2' WHEN 2 THEN text || ' steel Part-ii' ELSE text END AS query
FROM benchmark
UNION ALL
SELECT 'C-' || {_T('conv_id')} || '-' || {_T('turn')} AS query_id,
  CASE (conv_id + turn) % 9
    WHEN 0 THEN '  Cement  ' || text WHEN 1 THEN 'IS 269 ' || text WHEN 2 THEN 'batao ' || text || ' code' WHEN 3 THEN text || ' cement part 2'
    WHEN 4 THEN text || ' part ii' WHEN 5 THEN 'cemnt opc 43 fly ash is 269 ' || text || ' is good' WHEN 6 THEN 'Hello!' WHEN 7 THEN 'hello! ' ELSE text END AS query
FROM conversations WHERE role = 'user'"""

#: Result sets: one query an order, its line items' parts as retrieved ids.
RESULTS = f"""
SELECT o.o_orderkey AS seq, {_T('o.o_orderkey')} AS query_id, 'IS ' || {_T('(o.o_orderkey % 50)')} || ': 1990' AS expected,
  l.l_linenumber AS rank, 'IS ' || {_T('(l.l_partkey % 50)')} || ': ' || {_T('year(l.l_shipdate)')} AS retrieved, o.o_totalprice / 100000 AS latency_seconds
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey"""

#: Dictionary sections: seq, section, JSON body.
DICTIONARY = [
    (0, "cement_types", '{"OPC": "Ordinary Portland Cement", "ppc": "Portland Pozzolana Cement", "is": "Indian Standard", "note": ["not text"], "one": 1, "yes": true, "none": null, "Thha": "first", "thha": "[last] of two", "AN": "an {object}"}'),
    (1, "cement_admixtures_scm", '{"fly ash": "FA", "the": "the said", "opc 43 fly ash": "OPC with FA", "ash": "residue"}'),
    (2, "common_abbreviations", '{"thermo_mechanically_treated": ["tmt", "TMT bars"], "Ordinary_Cement": ["OPC", 5, null], "text": "tmt"}'),
    (3, "spelling_variants", '{"cement": ["cemnt", "Cemant"], "steel": ["stel"]}'),
    (4, "_comment", '{"x": "y"}'),
    (5, "unknown", '{"z": "w"}'),
]


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = [t for t in ("documents", "benchmark", "conversations", "orders", "lineitem") if f"FROM {t}" in text or f"JOIN {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def chunks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CHUNKS_RAW)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, QUERIES)


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RESULTS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = result_rows(spark, sf_dir)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "retrieved"))), lambda x: x["retrieved"])
    return rows.groupBy("seq", "query_id", "expected", "latency_seconds").agg(ids.alias("retrieved_standards")).withColumn("expected_standards", F.array("expected"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(1).alias("page"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, some of them turned into headings and citations."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.selectExpr("doc_id", "CAST(line_no AS BIGINT) AS line_no", "CAST(line_no div 40 AS INT) + 1 AS page", f"{LINE} AS text")


_ID = f"'IS ' || {_T('(doc_id % 500)')} || ': ' || {_T('(1960 + line_no % 40)')}"
LINE = f"CASE WHEN line_no % 28 = 14 THEN '🙂🙂🙂🙂🙂🙂 ' || {_ID} || ' ' || substring(line, 1, 30) WHEN line_no % 14 = 0 THEN {_ID} || ' ' || substring(line, 1, 30) WHEN line_no % 14 = 7 THEN {_ID} WHEN line_no % 11 = 3 THEN 'as per IS 456: 2000 ' || line ELSE line END"


def dictionary_sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "seq int, section string, body string")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
