"""Named queries over the test tables, each with its SQL where SQL can express it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship
from . import queries_composite, queries_io, queries_metrics, queries_pairs, queries_relational, queries_text  # noqa: F401  they register
from .registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(spark, folder)

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        return run

    return {k: shipped(f) for k, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
