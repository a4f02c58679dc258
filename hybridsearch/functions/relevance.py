"""Functions that judge and normalise query texts, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, trim_ws

# The word lists that decide whether a query belongs to the domain.
GREETINGS = [
    "hi", "hello", "hey", "helo", "hii", "hiii", "howdy", "yo", "sup", "good morning", "good afternoon", "good evening", "good night",
    "greetings", "salutations", "namaste", "namaskar", "hai", "kya haal", "kya hal", "salam", "assalam",
]
CONNECTORS = ["ka", "ke", "ki", "kya", "batao", "kaunsa", "liye", "mein"]
INTENTS = ["code", "standard", "bis", "number"]
HINTS = [
    "bis", "is", "standard", "cement", "steel", "pipe", "water", "concrete", "quality", "product", "material", "specification", "manufacture",
    "rubber", "textile", "food", "chemical", "paint", "wire", "cable", "brick", "tile", "glass", "plastic", "wood", "timber", "copper",
    "aluminium", "aluminum", "iron", "coal", "oil", "gas", "pressure", "safety", "weight", "dimension", "mse", "factory", "industrial", "bureau",
    "indian", "national", "grade", "class", "type", "requirement", "compressive", "tensile", "strength",
]
ID_IN_QUERY = r"(?<![\p{L}\p{N}_])is[\s:\u2013-]?[0-9]{2,5}(?![\p{L}\p{N}_])"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
GREETED = "Hello! Describe your product or requirement, and matching standards will be searched."
REJECTED = "This search covers product and material standards only. Please describe a product, material or requirement."


def _list(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def normalize_query(c: Column) -> Column:
    """Trimmed, lower case, single blanks."""
    return F.regexp_replace(F.lower(trim_ws(c)), f"{SPACE}+", " ")


def query_tokens(c: Column) -> Column:
    """White-space tokens; punctuation stays."""
    return F.filter(F.split(F.lower(c), f"{SPACE}+"), lambda w: w != "")


def is_greeting(c: Column) -> Column:
    """A bare greeting; trailing punctuation goes before the ends are trimmed, so it may not be followed by a blank."""
    return F.lower(trim_ws(F.regexp_replace(c, "[!?.,'\"]+$", ""))).isin(GREETINGS)


def is_mixed_language(c: Column) -> Column:
    """A connector of the second language together with an intent word."""
    tokens = query_tokens(c)
    return F.arrays_overlap(tokens, _list(CONNECTORS)) & F.arrays_overlap(tokens, _list(INTENTS))


def has_standard_number(c: Column) -> Column:
    return c.rlike("(?i)" + ID_IN_QUERY)


def has_domain_hint(c: Column) -> Column:
    return F.arrays_overlap(query_tokens(c), _list(HINTS))


def bare_query(c: Column) -> Column:
    """Trimmed, lower case, without trailing punctuation: what the plain relevance check looks at."""
    return trim_ws(F.regexp_replace(F.lower(trim_ws(c)), "[!?.,'\"]+$", ""))


def add_query_prefix(c: Column) -> Column:
    """A query as the vector encoder gets it."""
    return F.concat(F.lit(QUERY_PREFIX), c)
