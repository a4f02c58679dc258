"""Licence scan by a positional index of rare words.

Templates are licence texts and notices; each has a mandatory key phrase.  The templates' words get document frequencies over
all documents, and each template's rarest words (one of each stretch of ``SPACING`` words, two at least) are posted in the index
with their positions.  A file's words are looked up in it; a posting gives a place (template, start), and places at which ``NEEDED`` of a
template's posted words stand in the same relative position (all, of a template of few words) are candidates: cut, reflowed and
re-spaced copies keep relative positions, and an edit only divides them.  A candidate holds if the key phrase's words stand
consecutively within ``SLACK`` words of their place, for base phrases at their place.  The share of the template's words that stand
at their places is its score.  All of it is DataFrame functions: two passes over the texts, one for the frequencies, and
one that keeps the words of those files only that hold a posted word.

Cases: a null text is an empty one (no words, no labels, score 0, null places); a text of any length is searched whole; each row gives
one row, whatever its ``doc_id``; places that overlap all count; words that are equally rare go by their place in the template; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts as L
from .common import materialize

#: A template's stretches have so many words at least, and so many posted words have to stand in step.
SPACING, NEEDED = 8, 3
#: Words that a key phrase may be away from its place.
SLACK = 8


@dataclass(frozen=True)
class Template:
    """``base`` templates count as places; their key phrase is the whole text."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall("[0-9a-z]+", self.text.lower())

    @property
    def key_words(self) -> list[str]:
        return re.findall("[0-9a-z]+", self.key.lower())

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)

    @property
    def posted(self) -> int:
        return min(len(self.words), max(2, len(self.words) // SPACING))

    @property
    def needed(self) -> int:
        return min(NEEDED, self.posted)

    @property
    def slack(self) -> int:
        return 0 if self.base else SLACK


# The base phrases; then short notices, and whole texts.
TEMPLATES = [
    Template("mit", "under the mit license", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", "cc by nc", base=True),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("mit", L.MIT, "to deal in the software without restriction"),
    Template("bsd-3", L.BSD_3, "neither the name of the"),
    Template("isc", L.ISC, "this permission notice appear in all copies"),
    Template("zlib", L.ZLIB, "the origin of this software must not be misrepresented"),
    Template("apache-2", L.APACHE_2_NOTICE, "licensed under the apache license version 2"),
    Template("gpl", L.GPL_NOTICE, "under the terms of the gnu general public license"),
    Template("lgpl", L.LGPL_NOTICE, "under the terms of the gnu lesser general public license"),
    Template("mpl-2", L.MPL_2_NOTICE, "terms of the mozilla public license"),
    Template("unlicense", L.UNLICENSE, "free and unencumbered software released into the public domain"),
    Template("boost", L.BOOST, "any person or organization obtaining a copy of the software and accompanying documentation"),
]
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words() -> Column:
    """A text's words, with an empty one before them if the text begins with a break, and after them if it ends with one.

    Small letters of all scripts; the one other character whose small letter is a plain ASCII letter goes out of the way first, so
    that an ASCII word here was one in the text.
    """
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\u212a"), F.lit("\ue000"))
    return F.split(F.lower(text), _BREAK)


def document_frequencies(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """Documents that have each of the templates' words; one row a word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    own = docs.select(F.explode(F.array_intersect(_words(), F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in own.groupBy("word").agg(F.count("*").alias("n")).collect()}


def posted_words(template: Template, df: dict[str, int]) -> list[int]:
    """The position of the rarest word of each of ``template.posted`` stretches of the template."""
    n, k = len(template.words), template.posted
    return [min((i for i in range(n) if i * k // n == part), key=lambda i: (df.get(template.words[i], 0), i)) for part in range(k)]


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``found``: every place that holds as
    (template, start, share), in word positions from 0."""
    spark = docs.sparkSession
    df = document_frequencies(docs, templates)
    postings = [(t.words[at], k, at, t.needed) for k, t in enumerate(templates) for at in posted_words(t, df)]
    index = F.broadcast(spark.createDataFrame(postings, "word string, template int, at int, needed int"))  # bounded by the templates
    words = F.col("words")
    empty = lambda at: (F.element_at("words", at) == "").cast("int")
    some = F.arrays_overlap(words, F.array(*map(F.lit, sorted({p[0] for p in postings}))))
    rows = docs.select(F.col("doc_id").alias("doc_id"), _words().alias("words"))
    rows = rows.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        # of a text without words the only element is empty, or the first and last are
        F.greatest(F.size("words") - empty(1) - empty(-1), F.lit(0)).cast("bigint").alias("n_words"), empty(1).alias("skipped"), F.when(some, words).alias("words"),
    )
    rows = materialize(rows, "licence-words")
    files = rows.where("words is not null").select("row", F.slice("words", F.col("skipped") + 1, F.size("words")).alias("words"))

    hits = files.select("row", F.posexplode("words").alias("pos", "word")).join(index, "word")
    places = hits.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("start"), "needed").agg(F.count("*").alias("n")).where("n >= needed")
    of_row = materialize(places.groupBy("row").agg(F.collect_list(F.struct("template", "start")).alias("places")), "licence-places")

    texts = F.array(*[F.array(*map(F.lit, t.words)) for t in templates])
    keys = F.array(*[F.struct(F.lit(t.key_at).alias("at"), F.lit(t.slack).alias("slack"), F.array(*map(F.lit, t.key_words)).alias("words")) for t in templates])

    def holds(c: Column) -> Column:
        key = F.get(keys, c["template"])
        at = c["start"] + key["at"]
        # a phrase that would begin before the text cannot stand; slice() counts from 1
        return F.exists(F.sequence(at - key["slack"], at + key["slack"]), lambda b: (b >= 0) & (F.slice(words, F.greatest(b, F.lit(0)) + 1, F.size(key["words"])) == key["words"]))

    def share(c: Column) -> Column:
        text = F.get(texts, c["template"])
        same = F.filter(text, lambda w, j: F.coalesce(F.get(words, F.when(c["start"] + j >= 0, c["start"] + j)) == w, F.lit(False)))
        return F.size(same) / F.size(text)

    found = F.transform(F.filter("places", holds), lambda c: F.struct(c["template"].alias("template"), c["start"].alias("start"), share(c).alias("share")))
    held = files.join(of_row, "row").select("row", found.alias("found")).where(F.size("found") > 0)
    none = F.array().cast("array<struct<template:int,start:int,share:double>>")
    joined = rows.select("row", "doc_id", "n_words").join(held, "row", "left").withColumn("found", F.coalesce("found", none))

    base, labels = F.array(*[F.lit(t.base) for t in templates]), F.array(*[F.lit(t.label) for t in templates])
    named = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda c: F.get(labels, c["template"])))), ",")
    starts = F.transform("places", lambda c: c["start"])
    return joined.withColumn("places", F.filter("found", lambda c: F.get(base, c["template"]))).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        named(F.col("places")).alias("base_labels"),
        named(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda c: c["share"])), F.lit(0.0)).alias("score"),
        "found",
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _scan_sql(templates: list[Template]) -> str:
    """The same in DuckDB SQL: words and postings as rows."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n    ".join(f"({k}, '{t.label}', {quoted(t.words)}, {quoted(t.key_words)}, {t.key_at}, {str(t.base).lower()}, {t.posted}, {t.needed}, {t.slack})" for k, t in enumerate(templates))
    return rf"""
WITH templates(template, label, tw, kw, key_at, is_base, posted, needed, slack) AS (
  VALUES {rows}
), texts AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), vocabulary AS (
  SELECT template, unnest(tw) AS word, unnest(range(len(tw))) AS at_word, len(tw) AS n, posted, needed FROM templates
), words AS (
  SELECT * FROM (SELECT row_no, unnest(w) AS word, unnest(range(len(w))) AS place FROM texts) WHERE word IN (SELECT word FROM vocabulary)
), frequencies AS (
  SELECT word, count(DISTINCT row_no) AS df FROM words GROUP BY word
), postings AS (
  SELECT template, word, at_word, needed FROM vocabulary LEFT JOIN frequencies USING (word)
  QUALIFY row_number() OVER (PARTITION BY template, at_word * posted // n ORDER BY coalesce(df, 0), at_word) = 1
), candidates AS (
  SELECT row_no, template, place - at_word AS start FROM words JOIN postings USING (word) GROUP BY ALL HAVING count(*) >= min(needed)
), found AS (
  SELECT row_no, label, is_base, start,
         CAST(len(list_filter(range(len(tw)), lambda j: start + j >= 0 AND coalesce(w[start + j + 1] = tw[j + 1], false))) AS DOUBLE) / len(tw) AS share
  FROM candidates JOIN texts USING (row_no) JOIN templates USING (template)
  WHERE len(list_filter(range(start + key_at - slack, start + key_at + slack + 1), lambda b: b >= 0 AND w[b + 1 : b + len(kw)] = kw)) > 0
), by_row AS (
  SELECT row_no, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found GROUP BY row_no
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM texts LEFT JOIN by_row USING (row_no)
"""


SCAN_SQL = _scan_sql(TEMPLATES)
