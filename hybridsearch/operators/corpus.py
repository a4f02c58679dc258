"""Corpus preparation: lines to records, one record an id, records to overlapping windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

WINDOW, STEP, TITLE_LINE = 4, 2, 120


def pages_to_lines(pages: DataFrame, text: str = "text", page: str = "page") -> DataFrame:
    """Trimmed non-empty lines of page texts: the other columns, ``page``, ``page_line`` and ``text``."""
    own = [c for c in pages.columns if c != text]
    lines = pages.select(*own, F.posexplode(F.split(text, "\n")).alias("page_line", "line"))
    return lines.select(*own, "page_line", T.trim_ws(F.col("line")).alias("text")).where("text <> ''")


def detect_headings(lines: DataFrame) -> DataFrame:
    """``lines`` with the first record id (``raw_id``), its ``id_start``, the ``tail`` behind it and ``is_heading``."""
    c = F.col("text")
    return lines.withColumns({"raw_id": T.heading_id(c), "id_start": T.heading_start(c), "tail": F.when(T.heading_start(c) >= 0, T.heading_tail(c)).otherwise(""), "is_heading": (T.heading_start(c) >= 0) & T.is_real_heading(c)})


def segment_lines(lines: DataFrame) -> DataFrame:
    """Records of ``lines(doc_id, line_no, page, text)``: ``doc_id, seq, standard_id, title, text, page_number, category, source``.

    A heading opens a record, the lines up to the next one are its body.  Its title is what follows the id, or else the
    first short line that does not end in a full stop, which then leaves the body.  Records without a body go.  A document's lines
    meet in one task, in order, so a document must fit into it; documents are spread over all tasks.
    """
    of_doc = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = detect_headings(lines).withColumn("segment", F.sum(F.col("is_heading").cast("int")).over(of_doc)).where("segment > 0")
    rows = marked.groupBy("doc_id", "segment").agg(F.array_sort(F.collect_list(F.struct("line_no", "page", "text", "raw_id", "tail"))).alias("lines"))
    head = F.get("lines", F.lit(0))
    rows = rows.select("doc_id", head.alias("head"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("body"))
    named = T.clean_title_suffix(T.strip_marks(F.col("head.tail")))
    rows = rows.withColumn("named", F.when(F.length(named) > 3, named))
    short = F.filter("body", lambda x: (F.length(x["text"]) < TITLE_LINE) & ~F.endswith(x["text"], F.lit(".")))
    rows = rows.withColumn("title_line", F.when(F.col("named").isNull(), F.get(short, F.lit(0))))
    rows = rows.withColumn("body", F.filter("body", lambda x: F.coalesce(x["line_no"] != F.col("title_line.line_no"), F.lit(True)))).where(F.size("body") > 0)
    title = F.coalesce("named", "title_line.text")
    text = F.concat(F.col("head.raw_id"), F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" -- "), title)).otherwise(""), F.lit("\n"), F.array_join(F.transform("body", lambda x: x["text"]), " "))
    return rows.select(
        "doc_id", F.col("head.line_no").cast("bigint").alias("seq"), T.normalize_standard_id(F.col("head.raw_id")).alias("standard_id"),
        F.when(T.is_toc_title(title), "").otherwise(F.coalesce(title, F.lit(""))).alias("title"), T.trim_ws(text).alias("text"),
        F.col("head.page").alias("page_number"), F.lit("").alias("category"), F.lit("").alias("source"),
    )


def filter_min_content(records: DataFrame) -> DataFrame:
    """Without records of fewer than 50 characters."""
    return records.where(F.length(T.trim_ws(F.col("text"))) >= T.MIN_CONTENT)


def _longest(records: DataFrame) -> DataFrame:
    own = [c for c in records.columns if c != "standard_id"]
    best = F.max_by(F.struct(*own), F.struct(F.length("text"), -F.col("seq")))
    return records.groupBy("standard_id").agg(best.alias("best"), F.min("seq").alias("first_seq")).select("standard_id", *[F.col(f"best.{c}").alias(c) for c in own], "first_seq")


def dedup_keep_longest(records: DataFrame) -> DataFrame:
    """One record an id: the longest text, the earliest ``seq`` among equals; then stubs go.  ``first_seq`` is the id's first."""
    return _longest(records).where(F.length("text") >= T.MIN_CONTENT)


def dedup_report(records: DataFrame) -> DataFrame:
    """``n_raw, n_unique, n_valid, n_dropped`` of a deduplication."""
    longest = records.groupBy("standard_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    valid = F.sum((F.col("longest") >= T.MIN_CONTENT).cast("int"))
    return longest.agg(zero(F.sum("n")).alias("n_raw"), F.count("*").alias("n_unique"), zero(valid).alias("n_valid"), (F.count("*") - zero(valid)).alias("n_dropped"))


def normalize_records(raw: DataFrame) -> DataFrame:
    """Raw chunks with canonical ids, cleaned titles and trimmed texts of 50 characters or more."""
    title = F.coalesce("title", F.lit(""))
    cleaned = raw.withColumns({
        "standard_id": T.normalize_standard_id(F.coalesce("standard_id", F.lit(""))),
        "title": T.clean_title_suffix(F.when(T.is_toc_title(title), "").otherwise(title)),
        "text": T.trim_ws(F.coalesce("text", F.lit(""))),
        "category": F.coalesce("category", F.lit("")),
    })
    return filter_min_content(cleaned)


def create_child_chunks(parents: DataFrame) -> DataFrame:
    """Windows of four sentences, two apart: the parents' columns but ``text``, ``window_no``, ``raw_window`` and ``text``.

    The parent's text is not repeated in its windows; join it by ``standard_id`` where it is needed.
    """
    own = [c for c in parents.columns if c != "text"]
    cut = parents.withColumn("sentences", T.split_sentences(F.col("text"))).where(F.size("sentences") > 0)
    windows = F.transform(F.sequence(F.lit(0), F.size("sentences") - 1, F.lit(STEP)), lambda i: F.array_join(F.slice("sentences", i + 1, WINDOW), " "))
    rows = cut.select(*own, F.posexplode(windows).alias("window_no", "raw_window"))
    prefix = T.context_prefix(F.col("standard_id"), F.col("title"), F.col("category"))
    return rows.withColumn("text", F.concat(prefix, F.col("raw_window")))


def prepare_corpus(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of raw chunks ``seq, standard_id, title, text, page_number, category, source``."""
    parents = dedup_keep_longest(normalize_records(raw)).drop("first_seq")
    return parents, create_child_chunks(parents)


def select_index_chunks(parents: DataFrame, children: DataFrame) -> DataFrame:
    """What is indexed: the children, or the parents if there are no children."""
    return parents if children.isEmpty() else children
