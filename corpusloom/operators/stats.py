"""Significance, drift and resampling."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EXACT_BELOW = 25
MOST_ROWS = 1_000_000  # that are resampled as rows


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series) -> pd.Series:
    """P(chi-squared with one degree of freedom > x)."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(v / 2)))


def _binomial_two_sided(k: Column, n: Column) -> Column:
    """min(1, 2 * P(X <= k)) for X of n fair coins, by a fold over the terms."""
    half = F.pow(F.lit(0.5), n.cast("double"))
    zero = F.struct(half.alias("term"), half.alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(steps, zero, lambda a, i: F.struct((a["term"] * (n - i + 1) / i).alias("term"), (a["sum"] + a["term"] * (n - i + 1) / i).alias("sum")), lambda a: a["sum"])
    return F.least(F.lit(1.0), 2 * total)


def mcnemar(df: DataFrame, key: str, model: str, correct: str) -> DataFrame:
    """All pairs of models on the rows that all of them have: discordant counts, the test used and
    its p. Exact below 25 discordant rows, else chi-squared with continuity correction.

    Models are few, so each row becomes one array of its models and pairs are taken inside it;
    the rows are shuffled once, by key.
    """
    n_models = df.agg(F.count_distinct(model).alias("k"))
    per = df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.col(model).alias("m"), F.col(correct).cast("boolean").alias("c")))).alias("all"))
    per = per.crossJoin(F.broadcast(n_models)).where(F.size("all") == F.col("k"))
    pairs = per.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where("a.m < b.m")
    got = pairs.groupBy(F.col("a.m").alias("model_a"), F.col("b.m").alias("model_b")).agg(F.count("*").alias("n"), F.count_if(F.expr("a.c and not b.c")).alias("only_a"), F.count_if(F.expr("not a.c and b.c")).alias("only_b"))
    d = F.col("only_a") + F.col("only_b")
    chi = F.try_divide(F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(2.0)), d)
    got = got.withColumn("discordant", d).withColumn("test", F.when(d < EXACT_BELOW, "exact").otherwise("chi2")).withColumn("statistic", F.when(d >= EXACT_BELOW, chi))
    small = F.when(d < EXACT_BELOW, _binomial_two_sided(F.least("only_a", "only_b"), d))
    return got.withColumn("p", F.round(F.coalesce(small, _chi2_tail("statistic")), 6)).withColumn("statistic", F.round("statistic", 6))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for any whole number of degrees of freedom, by the finite series
    in the angle whose tangent is t over the root of them; null for none."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    odd = df % 2 == 1
    square = F.cos(angle) * F.cos(angle)
    first = F.when(odd, F.cos(angle)).otherwise(F.lit(1.0))
    n = F.floor((df - 2) / 2).cast("long")  # terms after the first
    steps = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    zero = F.struct(first.alias("term"), first.alias("sum"))
    add = lambda a, k: F.struct((a["term"] * ratio(k) * square).alias("term"), (a["sum"] + a["term"] * ratio(k) * square).alias("sum"))
    total = F.sin(angle) * F.aggregate(steps, zero, add, lambda a: a["sum"])
    inside = F.when(odd, 2 / math.pi * (angle + F.when(df > 1, total).otherwise(0.0))).otherwise(total)
    return F.when(df > 0, F.greatest(F.lit(0.0), 1 - inside))


def drift(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Last minus first, slope, R squared and p of a least-squares line, with three points or more. Where
    R squared is 1, as it is if all values are equal, p is null, as in the SQL of the queries."""
    got = df.where(F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n_points"), (F.max_by(y, x) - F.min_by(y, x)).alias("td"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    r2 = F.col("r2")
    t = F.sqrt(F.try_divide(r2 * (F.col("n_points") - 2), 1 - r2))
    p = F.when(r2 < 1, t_tail(t, F.col("n_points") - 2))
    enough = F.col("n_points") >= 3
    return got.select(*by, "n_points", *[F.when(enough, F.round(v, 6)).alias(n) for n, v in (("td", F.col("td")), ("slope", F.col("slope")), ("r2", r2), ("p_ols", p))])


def mean_rank(value: str, part: list[str]) -> Column:
    """Ranks with ties averaged."""
    w = W.partitionBy(*part)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*part, value)) - 1) / 2


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation and its p, with three points or more; p of a perfect correlation is 0. Where
    all values of a side are equal the correlation is NaN, and its p 0, as in the SQL of the queries.
    """
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", mean_rank(x, by)).withColumn("_y", mean_rank(y, by))
    varies = (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    corr = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))  # F.corr divides by zero
    got = r.groupBy(*by).agg(F.count("*").alias("n_points"), F.when(varies, corr).otherwise(math.nan).alias("rho"))
    rho, n = F.col("rho"), F.col("n_points")
    p = F.when(F.isnan(rho) | (F.abs(rho) > 1 - 1e-12), 0.0).otherwise(t_tail(rho * F.sqrt((n - 2) / ((1 - rho) * (1 + rho))), n - 2))
    return got.select(*by, "n_points", *[F.when(n >= 3, F.round(v, 6)).alias(c) for c, v in (("rho", rho), ("p_rho", p))])


def bootstrap(df: DataFrame, cells: list[str], metric: Callable[[np.ndarray], np.ndarray], draws: int = 2000, seed: int = 42, level: float = 0.95, by: str | None = None) -> DataFrame:
    """Percentile interval of a metric under resampling n rows of n.

    A metric of labels depends on the counts of its cells (gold by predicted) only, and the counts
    of a resample are multinomial, so only the cells are resampled, never the rows: the work is
    draws times cells, whatever n. ``metric`` maps an array of counts (draws x cells) to values;
    resamples where it is undefined are left out, and at least half must be defined. ``by``: one
    interval for each value of a string column.
    """
    counts = df.groupBy(*([by] if by else []), *cells).agg(F.count("*").alias("n"))
    names = cells

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cells)
        n = pdf["n"].to_numpy()
        rng = np.random.default_rng(seed)
        keys = [tuple(r) for r in pdf[names].itertuples(index=False)]
        point = metric(n[None, :], keys)[0]
        values = metric(rng.multinomial(n.sum(), n / n.sum(), size=draws), keys)
        values = values[~np.isnan(values)]
        lo, hi = np.percentile(values, [50 * (1 - level), 50 * (1 + level)]) if 2 * len(values) >= draws else (None, None)
        out = pd.DataFrame({"n": [int(n.sum())], "value": [float(point)], "low": [lo], "high": [hi]})
        return out.assign(**{by: pdf[by].iloc[0]}) if by else out

    schema = "n long, value double, low double, high double" + (f", {by} string" if by else "")
    return counts.groupBy(by or F.lit(1).alias("_one")).applyInPandas(run, schema)


def kappa_of_cells(counts: np.ndarray, keys: list[tuple]) -> np.ndarray:
    """Nominal kappa of each row of counts."""
    labels = sorted({str(x) for k in keys for x in k})
    a = np.array([labels.index(str(k[0])) for k in keys])
    b = np.array([labels.index(str(k[1])) for k in keys])
    rows, cols = (np.stack([counts[:, s == i].sum(axis=1) for i in range(len(labels))], axis=1) for s in (a, b))
    n = counts.sum(axis=1)
    expected = 1 - (rows * cols).sum(axis=1) / (n * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - (counts[:, a != b].sum(axis=1) / n) / np.where(expected > 0, expected, np.nan)


def f1_of_cells(counts: np.ndarray, keys: list[tuple]) -> np.ndarray:
    """Binary F1 of each row of counts; keys are (gold, predicted) of 0 and 1."""
    tp, fp, fn = (counts[:, [i for i, k in enumerate(keys) if k == want]].sum(axis=1) for want in ((1, 1), (0, 1), (1, 0)))
    return np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0)


def bootstrap_rows(df: DataFrame, metric: Callable[[pd.DataFrame], float], draws: int = 200, seed: int = 42) -> DataFrame:
    """``(draw, value)`` of any metric of whole rows, for metrics that no cells carry. The rows must
    fit one task, so more than ``MOST_ROWS`` are an error; every draw is a task of its own."""
    if (n := df.count()) > MOST_ROWS:
        raise ValueError(f"{n} rows, more than {MOST_ROWS}: resample the cells of the metric with bootstrap()")
    held = df.sparkSession.sparkContext.broadcast(df.toPandas())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["draw"].iloc[0])
        rng = np.random.default_rng([seed, b])
        rows = held.value
        return pd.DataFrame({"draw": [b], "value": [float(metric(rows.iloc[rng.integers(0, len(rows), len(rows))]))]})

    return df.sparkSession.range(draws).withColumnRenamed("id", "draw").groupBy("draw").applyInPandas(run, "draw long, value double")
