"""JSON in answers: extraction, tolerant and repairing parsers, canonical form. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.taxonomy import CODES

# The keys of an answer and their aliases in order.
KEYS = {"csrd_category": ["csrd_category", "category"], "esrs_subcategory": ["esrs_subcategory", "subcategory"], "chain_of_thought": ["chain_of_thought", "rationale"]}


def outermost(c: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such span."""
    got = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(got != "", got)


def to_map(c: Column) -> Column:
    """An object as a map of strings with trimmed lower-case keys; null if it does not parse."""
    m = F.from_json(c, "map<string,string>", {"allowSingleQuotes": "false"})
    return F.when(m.isNotNull(), F.map_from_entries(F.array_distinct(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value"))))))


def key_of(m: Column, name: str) -> Column:
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in KEYS[name]])


def tolerant(c: Column) -> Column:
    """Category, subcategory and rationale of an answer. What does not parse or names no known
    category is ``none``; a none has no subcategory; missing texts are empty."""
    m = to_map(outermost(c))
    cat = key_of(m, "csrd_category")
    cat = F.when(F.coalesce(cat.isin(CODES), F.lit(False)), cat).otherwise("none")
    sub = F.when(cat == "none", "").otherwise(F.coalesce(key_of(m, "esrs_subcategory"), F.lit("")))
    return F.struct(cat.alias("category"), sub.alias("subcategory"), F.coalesce(key_of(m, "chain_of_thought"), F.lit("")).alias("rationale"))


def repaired_text(c: Column) -> Column:
    """Single quotes to double ones, Python's constants to JSON's, commas before a close dropped."""
    t = F.replace(outermost(c), F.lit("'"), F.lit('"'))
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        t = F.regexp_replace(t, rf"\b{a}\b", b)
    return F.regexp_replace(t, r",\s*([}\]])", "$1")


def repaired_category(c: Column) -> Column:
    """The category of an answer, parsed as it is or after repair; null if neither or not known."""
    first, second = key_of(to_map(outermost(c)), "csrd_category"), key_of(to_map(repaired_text(c)), "csrd_category")
    cat = F.coalesce(first, second)
    return F.when(cat.isin(CODES), cat)


def canonical(category: Column, subcategory: Column, rationale: Column) -> Column:
    """The three keys in their order; nulls stay."""
    return F.to_json(F.struct(category.alias("csrd_category"), subcategory.alias("esrs_subcategory"), rationale.alias("chain_of_thought")), {"ignoreNullFields": "false"})


def validity(c: Column) -> Column:
    """``ok``, or why an answer cannot train: unparsable, invalid category, no rationale."""
    m = to_map(c)
    cat, why = F.try_element_at(m, F.lit("csrd_category")), F.try_element_at(m, F.lit("chain_of_thought"))
    return F.when(m.isNull(), "unparsable").when(~F.coalesce(cat.isin(CODES), F.lit(False)), "category").when(F.coalesce(F.trim(why), F.lit("")) == "", "rationale").otherwise("ok")
