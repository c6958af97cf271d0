"""Agreement of two annotators: observed agreement and Cohen's kappa, nominal or weighted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import to_bool
from .taxonomy import pillar, rank

# Bands of kappa and their names in French and English.
BANDS = [(0.0, "Pas d'accord (< hasard)", "poor (worse than chance)"), (0.20, "Accord négligeable", "slight"), (0.40, "Accord faible", "fair"), (0.60, "Accord modéré", "moderate"), (0.80, "Accord substantiel", "substantial")]
TOP = ("Accord quasi-parfait", "almost perfect")
UNKNOWN = ("Indéfini", "undefined")


def band(kappa: Column, english: bool = True) -> Column:
    out = F.when(kappa.isNull(), UNKNOWN[english])
    for limit, fr, en in BANDS:
        out = out.when(kappa < limit, en if english else fr)
    return out.otherwise(TOP[english])


WEIGHTS = {"nominal": lambda a, b: (a != b).cast("int"), "quadratic": lambda a, b: (a - b) * (a - b)}


def kappa(df: DataFrame, by: list[str], a: str, b: str, weight: str | Callable[[Column, Column], Column] = "nominal") -> DataFrame:
    """``n, agreement, kappa`` by group. ``weight`` is nominal, quadratic over numeric ranks, or the
    weight of two values itself.

    Pairs with a null on either side are left out. From the cells of the confusion alone:
    1 - sum(w * observed) / sum(w * expected), null if nothing can disagree (one class on both
    sides). The marginals come from windows over the cells, which are as few as pairs of labels.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_o"))
    key = by or [F.lit(1)]
    rows = cells.groupBy(*by, "_a").agg(F.sum("_o").alias("_r")).withColumn("_n", F.sum("_r").over(W.partitionBy(*key)))
    cols = cells.groupBy(*by, "_b").agg(F.sum("_o").alias("_c"))
    grid = (rows.join(cols, by) if by else rows.crossJoin(F.broadcast(cols))).join(cells, [*by, "_a", "_b"], "left")
    w = weight(F.col("_a"), F.col("_b")) if callable(weight) else WEIGHTS[weight](F.col("_a"), F.col("_b"))
    o = F.coalesce("_o", F.lit(0))
    got = grid.groupBy(*by).agg(F.max("_n").alias("n"), F.sum(w * o).cast("double").alias("_wo"), F.sum(w * F.col("_r") * F.col("_c") / F.col("_n")).alias("_we"), F.sum(F.when(F.col("_a") == F.col("_b"), o).otherwise(0)).alias("_same"))
    return got.select(*by, "n", F.round(F.col("_same") / F.col("n") * 100, 6).alias("agreement"), F.round(1 - F.try_divide("_wo", "_we"), 6).alias("kappa"))


def unpivot_pairs(df: DataFrame, variables: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``(variable, a, b)`` of several annotated variables, as strings, in one pass."""
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), a.cast("string").alias("a"), b.cast("string").alias("b")) for v, (a, b) in variables.items()])
    return df.select(F.inline(rows))


def report(df: DataFrame, nominal: dict[str, tuple[Column, Column]], ordinal: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Agreement of every variable with the band of its kappa: one aggregation, whatever the
    number of variables."""

    def weight(a: Column, b: Column) -> Column:
        apart = a.try_cast("int") - b.try_cast("int")
        return F.when(F.col("variable").isin(list(ordinal)), apart * apart).otherwise((a != b).cast("int"))

    return kappa(unpivot_pairs(df, nominal | ordinal), ["variable"], "a", "b", weight).withColumn("band", band(F.col("kappa")))


def ten_variables(df: DataFrame, names: tuple[str, str], scales: dict[str, list[str]]) -> DataFrame:
    """The report of two annotators on ten variables: category, pillar, subcategory (with missing
    as a class, and among rows that both find relevant), score, two flags, surprise, horizon (with
    missing as a class, and as ranks where both give one)."""

    def two(c: str, f: Callable[[Column], Column] = lambda x: x) -> tuple[Column, Column]:
        return f(F.col(f"{c}_{names[0]}")), f(F.col(f"{c}_{names[1]}"))

    def present(x: Column) -> Column:
        return F.coalesce(F.nullif(x, F.lit("")), F.lit("n/a"))

    a, b = two("csrd_category")
    relevant = (a != "none") & (b != "none")
    nominal = {
        "category": (a, b),
        "pillar": two("csrd_category", pillar),
        "subcategory": two("esrs_subcategory", present),
        "subcategory_conditional": two("esrs_subcategory", lambda x: F.when(relevant, x)),
        "financial": two("financial", to_bool),
        "impact": two("impact", to_bool),
        "horizon": two("horizon", present),
    }
    ordinal = {"score": two("score"), "surprise": two("surprise", lambda x: rank(scales["surprise"], x)), "horizon_conditional": two("horizon", lambda x: rank(scales["horizon"], x))}
    return report(df, nominal, ordinal)


def disagreements(df: DataFrame, columns: list[str], names: tuple[str, str]) -> DataFrame:
    """Rows on which the two sides differ in some column, nulls being values, with those columns."""
    diff = F.filter(F.array(*[F.when(~F.col(f"{c}_{names[0]}").eqNullSafe(F.col(f"{c}_{names[1]}")), c) for c in columns]), lambda x: x.isNotNull())
    return df.withColumn("differs", diff).where(F.size("differs") > 0)
