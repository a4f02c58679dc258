"""Relevance of queries to the domain, for tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import relevance as R
from ..functions.text import strip_fences
from .dictionary import expand_abbreviations, fix_spellings


def classify_queries(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``queries`` with ``is_relevant, reason, primary_query, expanded_query, has_expansions, message``.

    A greeting is rejected; else the first of mixed language, a record number, a domain word or an expansion
    makes a query relevant; else it is rejected.  The primary query is only normalised.
    """
    raw = F.col("query")
    rows = queries.withColumn("primary_query", R.normalize_query(raw))
    rows = expand_abbreviations(fix_spellings(rows, dictionary, "primary_query", "_fixed"), dictionary, "_fixed", "expanded_query").drop("_fixed")
    primary = F.col("primary_query")
    rows = rows.withColumn("has_expansions", F.col("expanded_query") != primary).withColumn(
        "reason",
        F.when(R.is_greeting(raw), "greeting")
        .when(R.is_mixed_language(primary), "mixed language")
        .when(R.has_standard_number(primary), "number")
        .when(R.has_domain_hint(primary), "keyword")
        .when(F.col("has_expansions"), "expansion")
        .otherwise("rejected"),
    )
    relevant = ~F.col("reason").isin("greeting", "rejected")
    only = lambda c, other: F.when(F.col("is_relevant"), c).otherwise(other)
    return rows.withColumn("is_relevant", relevant).withColumns({
        "primary_query": only(primary, F.lit("")),
        "expanded_query": only(F.col("expanded_query"), F.lit("")),
        "has_expansions": F.col("has_expansions") & F.col("is_relevant"),
        "message": F.when(F.col("reason") == "greeting", R.GREETED).when(F.col("reason") == "rejected", R.REJECTED).otherwise(""),
    })


def _fallback(raw: Column) -> tuple[Column, Column]:
    """(relevant, message) of the plain check."""
    bare = R.bare_query(raw)
    greeting, hint = bare.isin(R.GREETINGS), R.has_domain_hint(bare)
    return ~greeting & hint, F.when(greeting, R.GREETED).when(hint, "").otherwise(R.REJECTED)


def relevance_fallback(queries: DataFrame) -> DataFrame:
    """``queries`` with ``is_relevant, search_query, message`` by greetings and domain words; the query stays as it is."""
    relevant, message = _fallback(F.coalesce("query", F.lit("")))
    return queries.withColumn("is_relevant", relevant).withColumn("search_query", F.when(F.col("is_relevant"), F.col("query")).otherwise("")).withColumn("message", message)


def parse_expansion_response(responses: DataFrame) -> DataFrame:
    """``responses(query, response)`` with ``is_relevant, search_query, message`` from a model's JSON answers.

    A missing field counts as relevant, the query itself and no message; an answer that is no JSON object leaves the plain check.
    """
    relevant, message = _fallback(F.coalesce("query", F.lit("")))
    schema = "relevant boolean, expanded_query string, message string, _corrupt_record string"
    rows = responses.withColumn("r", F.from_json(strip_fences(F.col("response")), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    parsed = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    said = F.coalesce("r.relevant", F.lit(True))
    note = F.coalesce("r.message", F.lit(""))
    return rows.select(
        *responses.columns,
        F.when(parsed, said).otherwise(relevant).alias("is_relevant"),
        F.when(parsed, F.when(said, F.coalesce(F.nullif("r.expanded_query", F.lit("")), "query")).otherwise("")).otherwise(F.when(relevant, F.col("query")).otherwise("")).alias("search_query"),
        F.when(parsed, F.when(said, "").otherwise(F.when(note == "", R.REJECTED).otherwise(note))).otherwise(message).alias("message"),
    )
