"""Equi joins, semi and anti joins, and look-ups. No join here needs a nested loop: an OR of two
keys is two anti joins, a prefix is a computed key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import signature


def base_id(c: Column) -> Column:
    """An id without the suffix of an oversampled copy."""
    return F.regexp_replace(c, "__dup[0-9]+$", "")


def paired(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join with every other column suffixed by its side."""

    def named(df: DataFrame, s: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_{s}" for c in df.columns if c != key})

    return named(a, suffixes[0]).join(named(b, suffixes[1]), key)


def missing(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """``(key, missing)``: ids that only one side has, and the side that lacks them."""
    return a.join(b, key, "left_anti").select(key, F.lit(names[1]).alias("missing")).unionByName(b.join(a, key, "left_anti").select(key, F.lit(names[0]).alias("missing")))


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Anti join; rows with a null key stay."""
    return df.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def without_signatures(df: DataFrame, other: DataFrame, n: int, content: str = "content") -> DataFrame:
    """Anti join on the first n characters of trimmed content; null content stays."""
    s = signature(F.col(content), n)
    held = other.where(F.col(content).isNotNull()).select(s.alias("_s")).distinct()
    return df.withColumn("_s", s).join(held, "_s", "left_anti").drop("_s")


def passes(df: DataFrame, first: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows not in ``excluded``, with the pass they belong to: iaa if in ``first``, else mass."""
    rest = without(df, excluded, key)
    return flag(rest, first, key, "_in").withColumn("pass", F.when(F.col("_in"), "iaa").otherwise("mass")).drop("_in")


def flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Adds whether the key is in the other table; never repeats a row."""
    held = other.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(held, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def leaked(pairs: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Pairs whose key is in the held-out table, with the id that copies share."""
    return pairs.join(held.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi").withColumn("base_id", base_id(F.col("pair_id")))


def seen_by_all(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that every group has."""
    n = df.agg(F.count_distinct(group).alias("_all"))
    return df.groupBy(key).agg(F.count_distinct(group).alias("_n")).crossJoin(F.broadcast(n)).where("_n = _all").select(key)


def prefix_lookup(df: DataFrame, reference: DataFrame, key: str, n: int, content: str = "content") -> DataFrame:
    """Adds ``found``, the least key of the reference rows with the same first n characters."""
    s = signature(F.col(content), n)
    first = reference.where(F.col(content).isNotNull()).groupBy(s.alias("_s")).agg(F.min(key).alias("found"))
    return df.withColumn("_s", s).join(first, "_s", "left").drop("_s")


