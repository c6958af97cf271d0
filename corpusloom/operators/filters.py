"""Predicates and filters with their rules on nulls."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import EPOCHS

# Spellings of true and of false, and of the French language.
TRUE = ["1", "true", "oui", "yes", "vrai", "x"]
YES, NO = ["oui", "true", "1", "vrai"], ["non", "false", "0", "faux"]
FRENCH = ["fr", "français", "french"]


def member(c: Column, values: list[str]) -> Column:
    """Trimmed lower-case membership; null is no member."""
    return F.coalesce(F.lower(F.trim(c)).isin(values), F.lit(False))


def truthy(c: Column) -> Column:
    return member(c, TRUE)


def in_dates(day: Column, first: str = "2010-01-01", last: str = "2026-12-31") -> Column:
    """Inclusive range; a null date is outside."""
    return F.coalesce(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))


def known_epoch(c: Column) -> Column:
    return c.isin(EPOCHS)


def where_or_all(df: DataFrame, keep: Column) -> DataFrame:
    """The rows that ``keep`` holds for, or all rows if it holds for none. The check is a one-row
    aggregate that goes to every task, so nothing is shuffled."""
    some = df.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("_some"))
    return df.crossJoin(F.broadcast(some)).where(F.coalesce(keep, F.lit(False)) | ~F.col("_some")).drop("_some")


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """``(step, name, n)``: rows left after each filter, in one aggregation over one scan."""
    conds, so_far = [("all", F.lit(True))], F.lit(True)
    for name, c in steps.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        conds.append((name, so_far))
    counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(conds)])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, (name, _) in enumerate(conds)])
    return counts.select(F.inline(rows))


def to_bool(c: Column) -> Column:
    """Yes and no in words or digits; anything else is null."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(YES), True).when(t.isin(NO), False)


def to_label(c: Column) -> Column:
    """Trimmed, blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def to_int(c: Column) -> Column:
    """A number in words of digits, cut to its whole part; anything else is null."""
    return c.try_cast("double").try_cast("long")


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def without_errors(df: DataFrame, column: str = "error") -> DataFrame:
    """Rows whose error is null or blank."""
    return df.where(F.coalesce(F.trim(column), F.lit("")) == "")


def relevant(c: Column) -> Column:
    """1 unless the label is ``none``; a null label counts as relevant, so policies on missing
    predictions are the caller's to state."""
    return (~c.eqNullSafe("none")).cast("long")


def first_matching_column(columns: list[str], keywords: list[str]) -> str | None:
    """The column whose name holds the first keyword that any holds; keywords go before columns.
    Names are compared in lower case, blanks and apostrophes as underlines."""
    low = {c: column_key(c) for c in columns}
    return next((c for k in keywords for c in columns if column_key(k) in low[c]), None)


def column_key(name: str) -> str:
    return re.sub(r"[\s'’]", "_", name.strip().lower())


def detect_columns(columns: list[str], wanted: dict[str, list[str]], required: tuple[str, ...] = ()) -> dict[str, str | None]:
    """Logical names bound to the columns of an export by their names; raises if a required one
    is not found."""
    found = {name: first_matching_column(columns, keys) for name, keys in wanted.items()}
    if lost := [r for r in required if found.get(r) is None]:
        raise ValueError(f"no column for {', '.join(lost)} among {', '.join(columns)}")
    return found


