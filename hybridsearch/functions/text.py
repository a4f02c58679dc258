"""Text and identifier functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and limits of the record format.
SPACE = r"[ \t\n\r\f\x0B]"
WORD = r"[\p{L}\p{N}_]"
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10, "XI": 11, "XII": 12}
HEADING = r"IS\s+[0-9]+(?:\s*\(Part\s*[0-9]+\))?(?:\s*\(Sec\s*[0-9]+\))?(?:\s*\(Section\s*[0-9]+\))?\s*:\s*[0-9]{4}"
CITATIONS = ["as per", "according to", "refer to", "in accordance", "shall be", "methods of", "procedures of", "specified in", "given in", "listed in", "covered in", "conforming to"]
HEADING_START, HEADING_LINE = 10, 160
TITLE_LENGTH, MIN_SENTENCE, MIN_CONTENT = 200, 20, 50


def trim_ws(c: Column) -> Column:
    """Without white space at both ends (ASCII white space, not blanks only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def strip_marks(c: Column) -> Column:
    """Without blanks, hyphens and colons at both ends."""
    return F.regexp_replace(c, "^[ :-]+|[ :-]+$", "")


def tokenize(c: Column) -> Column:
    """Lower-cased word runs."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}+)"), F.lit(1))


def normalize_standard_id(c: Column) -> Column:
    """The canonical spelling of a record id: single blanks, ``": "``, ``(Part n)`` and ``(Part n/Sec m)`` with Arabic numbers."""
    c = F.regexp_replace(trim_ws(c), f"{SPACE}+", " ")
    c = F.regexp_replace(c, r"\s*:\s*", ": ")
    c = F.regexp_replace(c, r"(IS\s*[0-9]+)\(", "$1 (")
    c = F.regexp_replace(c, rf"\(\s*(?i:part)\s*({WORD}+)\s*/\s*(?i:sec)\s*({WORD}+)\s*\)", "(Part $1/Sec $2)")
    c = F.regexp_replace(c, rf"\(\s*(?i:part)\s*({WORD}+)\s*\)", "(Part $1)")
    for numeral, number in ROMAN.items():
        c = F.regexp_replace(c, rf"\(Part (?i:{numeral})(\)|/Sec )", f"(Part {number}$1")
        c = F.regexp_replace(c, rf"(\(Part {WORD}+/Sec )(?i:{numeral})\)", f"$1{number})")
    return c


def is_toc_title(c: Column) -> Column:
    """Titles that are too long, or quote a numbered entry, come from tables of contents."""
    return (F.length(c) > TITLE_LENGTH) | c.rlike(r"[0-9]+\.[0-9]+\s+IS\s+[0-9]+")


def clean_title_suffix(c: Column) -> Column:
    """Without a trailing page number, then without marks at both ends."""
    return strip_marks(F.regexp_replace(c, rf"{SPACE}+[0-9]+(\.[0-9]+)?{SPACE}*$", ""))


def heading_id(c: Column) -> Column:
    """The first record id in a line, as spelled there; empty if there is none."""
    return F.regexp_extract(c, rf"(?i)(?<!{WORD})({HEADING})(?!{WORD})", 1)


def heading_start(c: Column) -> Column:
    """Characters (not UTF-16 units, which regexp_instr counts) before the first record id; -1 if there is none."""
    before = F.regexp_extract(c, rf"(?is)^(.*?)(?<!{WORD})(?:{HEADING})(?!{WORD})", 1)
    return F.when(heading_id(c) != "", F.length(before)).otherwise(-1).cast("int")


def heading_tail(c: Column) -> Column:
    """What follows the first record id."""
    return F.substr(c, heading_start(c) + F.length(heading_id(c)) + 1)


def is_real_heading(c: Column) -> Column:
    """A heading rather than a citation: near the line's start, short, and without citing phrases."""
    tail = trim_ws(heading_tail(c))
    cites = F.lower(tail).rlike("|".join(CITATIONS))
    near = heading_start(c).between(0, HEADING_START) & (F.length(c) <= HEADING_LINE)
    return near & ((tail == "") | tail.rlike("[A-Za-z]{2,}")) & ~cites


def split_sentences(c: Column) -> Column:
    """Trimmed sentences of 20 characters or more."""
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?]){SPACE}+"), trim_ws), lambda s: F.length(s) >= MIN_SENTENCE)


def context_prefix(standard_id: Column, title: Column, category: Column) -> Column:
    """What every window of a record begins with."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.concat(
        F.lit("Standard: "), standard_id,
        F.when(some(title), F.concat(F.lit(" -- "), title)).otherwise(""),
        F.when(some(category), F.concat(F.lit(" [Category: "), category, F.lit("]"))).otherwise(""),
        F.lit(". "),
    )


def _number(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("int")


def extract_part_number(c: Column) -> Column:
    """The part a record id names (``part 2``, ``Part-2``, or a trailing ``-2``), else null."""
    return F.coalesce(_number(c, r"(?i)part[\s-]?([0-9]+)"), _number(trim_ws(c), r"-([0-9]+)$"))


def extract_query_part(c: Column) -> Column:
    """The part a query asks for, in Arabic numbers or i to iv, else null."""
    roman = F.lower(F.regexp_extract(c, rf"(?i)part[\s-]?(iv|iii|ii|i)(?!{WORD})", 1))
    of_roman = F.when(roman == "i", 1).when(roman == "ii", 2).when(roman == "iii", 3).when(roman == "iv", 4)
    return F.coalesce(_number(c, r"(?i)part[\s-]?([0-9]+)"), of_roman)


def normalize_eval_id(c: Column) -> Column:
    """An id as evaluation compares it: without blanks, case and year."""
    return F.regexp_replace(F.lower(F.replace(c, F.lit(" "), F.lit(""))), r":[0-9]{4}$", "")


def strip_fences(c: Column) -> Column:
    """A model's answer without Markdown fences around it."""
    return F.regexp_replace(F.regexp_replace(trim_ws(c), rf"^```json{SPACE}*", ""), rf"{SPACE}*```$", "")
