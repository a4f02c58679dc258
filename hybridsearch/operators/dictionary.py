"""Dictionaries of abbreviations and spellings, and their use on query texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relevance import query_tokens

# The sections of a dictionary file by the direction of their entries.
DIRECT_SECTIONS = [
    "standards_bodies", "cement_types", "cement_admixtures_scm", "concrete_types", "aggregates", "lime_types", "steel_types", "concrete_products",
    "asbestos_cement_products", "building_limes", "stones", "bricks_masonry", "timber_wood", "gypsum", "bitumen_products",
    "waterproofing_damp_proofing", "floor_wall_roof", "sanitary_plumbing", "doors_windows", "hardware_fasteners", "paints_coatings",
    "thermal_insulation", "glass_products", "electrical_products", "polymer_materials",
]
INVERTED_SECTIONS = ["common_abbreviations", "cement_extended", "measurement_shortcuts", "technical_terms"]
SPELLING_SECTION = "spelling_variants"
LONGEST_PHRASE = 4
#: Dictionaries are sent to every task up to so many bytes of keys and values, and joined by a shuffle otherwise.
BROADCAST_BYTES = 64 << 20


def read_dictionary(sections: DataFrame) -> DataFrame:
    """``kind, key, value`` of ``sections(seq, section, body)``, ``body`` a JSON object; of equal keys the last in order wins.

    Direct sections hold {abbreviation: full form}, inverted ones {full_form: [abbreviations]} and the
    spelling section {right: [wrong]}.  Values that are no strings (or no lists of them), and sections of other names, are left out.
    """
    entries = sections.where(~F.startswith("section", F.lit("_"))).select(
        "seq", "section", F.posexplode(F.from_json("body", "map<string,variant>")).alias("pos", "name", "raw")
    )
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    direct = entries.where(F.col("section").isin(DIRECT_SECTIONS)).select(
        "seq", "pos", F.lit(0).alias("item"), F.lit("expansion").alias("kind"), F.lower("name").alias("key"), text(F.col("raw")).alias("value")
    )
    listed = entries.where(F.col("section").isin([*INVERTED_SECTIONS, SPELLING_SECTION]) & F.startswith(F.schema_of_variant("raw"), F.lit("ARRAY"))).select(
        "seq", "section", "pos", "name", F.posexplode(F.try_variant_get("raw", "$", "array<variant>")).alias("item", "entry")
    )
    spelling = F.col("section") == SPELLING_SECTION
    inverted = listed.select(
        "seq",
        "pos",
        "item",
        F.when(spelling, "spelling").otherwise("expansion").alias("kind"),
        F.lower(text(F.col("entry"))).alias("key"),
        F.when(spelling, F.col("name")).otherwise(F.replace("name", F.lit("_"), F.lit(" "))).alias("value"),
    )
    both = direct.unionByName(inverted).where("key is not null and value is not null")
    return both.groupBy("kind", "key").agg(F.max_by("value", F.struct("seq", "pos", "item")).alias("value"))


def _entries(dictionary: DataFrame, kind: str) -> DataFrame:
    """One kind of a dictionary, to be broadcast if its bytes, counted now, are within BROADCAST_BYTES."""
    own = dictionary.where(F.col("kind") == kind).select("key", "value")
    size = own.agg(F.sum(F.octet_length("key") + F.octet_length("value") + 32)).first()[0] or 0
    return F.broadcast(own) if size <= BROADCAST_BYTES else own


def fix_spellings(texts: DataFrame, dictionary: DataFrame, column: str = "query", to: str = "fixed") -> DataFrame:
    """``texts`` with ``to``: the tokens of ``column``, joined by blanks, every known misspelling replaced.

    Distinct texts' tokens are joined with the dictionary, whatever its size, and the few that are found are put in.
    """
    distinct = texts.select(F.col(column).alias("text")).distinct().withColumn("tokens", query_tokens(F.col("text")))
    found = distinct.select("text", F.posexplode("tokens").alias("i", "key")).join(_entries(dictionary, "spelling"), "key")
    hits = found.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("hits"))
    fixed = F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at("hits", i), t))
    rows = distinct.join(hits, "text", "left").select(F.col("text").alias(column), F.array_join(F.when(F.col("hits").isNull(), F.col("tokens")).otherwise(fixed), " ").alias(to))
    return _with(texts, rows, column, to)


def expand_abbreviations(texts: DataFrame, dictionary: DataFrame, column: str = "query", to: str = "expanded") -> DataFrame:
    """``texts`` with ``to``: the tokens of ``column``, joined by blanks, with phrases of up to four tokens expanded, greedily from
    the left, the longest first.

    The bare word ``is`` is expanded only before a number.  Distinct texts' phrases are joined with the dictionary, whatever
    its size, and each text is put together from those that are found.
    """
    distinct = texts.select(F.col(column).alias("text")).distinct().withColumn("tokens", query_tokens(F.col("text")))
    places = distinct.where(F.size("tokens") > 0).select("text", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("i"))
    phrases = places.select("text", "tokens", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_PHRASE), F.size("tokens") - F.col("i")))).alias("k"))
    phrases = phrases.select("text", "i", "k", F.lower(F.array_join(F.slice("tokens", F.col("i") + 1, F.col("k")), " ")).alias("key"), F.coalesce(F.get("tokens", F.col("i") + 1), F.lit("")).rlike(r"^[\p{Nd}]+$").alias("before_number"))
    found = phrases.join(_entries(dictionary, "expansion"), "key").where("key <> 'is' or before_number")
    longest = found.groupBy("text", "i").agg(F.max_by(F.struct("i", "k", "value"), "k").alias("hit"))
    hits = longest.groupBy("text").agg(F.array_sort(F.collect_list("hit")).alias("hits"))

    # from the left: a hit that begins behind the last one taken is taken, with the tokens between them
    def take(state, hit):
        ahead = F.slice("tokens", state["at"] + 1, hit["i"] - state["at"])
        taken = F.struct(F.concat(state["out"], ahead, F.array(hit["value"])).alias("out"), (hit["i"] + hit["k"]).alias("at"))
        return F.when(hit["i"] >= state["at"], taken).otherwise(state)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    whole = F.aggregate("hits", start, take, lambda s: F.concat(s["out"], F.slice("tokens", s["at"] + 1, F.size("tokens"))))
    rows = distinct.join(hits, "text", "left").select(F.col("text").alias(column), F.array_join(F.when(F.col("hits").isNull(), F.col("tokens")).otherwise(whole), " ").alias(to))
    return _with(texts, rows, column, to)


def _with(texts: DataFrame, rows: DataFrame, column: str, to: str) -> DataFrame:
    """``texts`` with the column ``to`` of ``rows``, by the text (null texts too)."""
    named = rows.select(F.col(column).alias("_text"), F.col(to).alias("_to"))
    return texts.join(named, texts[column].eqNullSafe(named["_text"]), "left").select(*[texts[c] for c in texts.columns if c != to], F.col("_to").alias(to))
