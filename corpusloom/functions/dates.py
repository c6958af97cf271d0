"""Dates and their buckets. What can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a date, first match wins; day before month.
FORMATS = [(r"^\d{4}-\d{2}-\d{2}", 10, "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}", 10, "dd/MM/yyyy"), (r"^\d{2}-\d{2}-\d{4}", 10, "dd-MM-yyyy"), (r"^\d{8}$", 8, "yyyyMMdd"), (r"^\d{4}/\d{2}/\d{2}", 10, "yyyy/MM/dd")]
# Last year of each period; the first begins in 2010.
PERIODS = [(2014, "2010-2014"), (2019, "2015-2019"), (2022, "2020-2022"), (2026, "2023-2026")]


def lenient_date(c: Column) -> Column:
    """The date a string begins with, in one of the accepted spellings."""
    t = F.trim(c)
    out = F.lit(None).cast("date")
    for shape, n, fmt in reversed(FORMATS):
        out = F.when(t.rlike(shape), F.try_to_timestamp(F.substring(t, 1, n), F.lit(fmt)).cast("date")).otherwise(out)
    return out


def year_of(c: Column) -> Column:
    """The year of a date column, 0 if null."""
    return F.coalesce(F.year(c), F.lit(0)).cast("long")


def year_bucket(year: Column) -> Column:
    """The period of a year; years outside 2010 to 2026 and null are ``other_year``."""
    out = F.when(F.coalesce(year, F.lit(0)) < 2010, "other_year")
    for last, name in PERIODS:
        out = out.when(year <= last, name)
    return out.otherwise("other_year")


def open_epoch(year: Column) -> Column:
    """As ``year_bucket``, but the first and last period are open; null and 0 are ``unknown``."""
    out = F.when(F.coalesce(year, F.lit(0)) == 0, "unknown")
    for last, name in PERIODS[:-1]:
        out = out.when(year <= last, name)
    return out.otherwise(PERIODS[-1][1])
