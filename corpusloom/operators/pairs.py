"""Preference pairs: typing of disagreements, budgets, balance caps, oversampling, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import ratio
from .ranking import draw

# The types of disagreement, the dominant one first.
TYPES = ["A_recency_fn", "B_overprediction_fp", "C_category_confusion"]
DOMINANT = TYPES[0]
# Expected yield of pairs by period.
YIELDS = {"2010-2014": 0.55, "2015-2019": 0.35, "2020-2022": 0.10, "2023-2026": 0.05}
RATIO, FLOOR, GUARDRAIL_RATIO = 3.0, 100, 5.0
REFUGE, REFUGE_LIMIT = "ESRS2", 0.20


def pair_type(silver: Column, base: Column) -> Column:
    """The type of a disagreement, null for agreement or a missing label."""
    a, b = silver != "none", base != "none"
    return F.when(silver == base, None).when(a & ~b, TYPES[0]).when(~a & b, TYPES[1]).when(a & b, TYPES[2])


def status(silver: Column, base: Column) -> Column:
    return F.when(silver.isNull() | base.isNull(), "api_error").when(silver == base, "agreement").otherwise("pair")


def diagnosis(df: DataFrame, silver: Column, base: Column) -> DataFrame:
    """One row: pairs, agreements, agreements on none, and rows with a failed call."""
    s = status(silver, base)
    counts = {"n_pair": s == "pair", "n_agreement": s == "agreement", "n_both_none": (silver == "none") & (base == "none"), "n_error": s == "api_error"}
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])


def within_budget(df: DataFrame, order: list[str], target: int, max_calls: int, calls: int = 2, is_pair: str = "is_pair") -> DataFrame:
    """The rows a loop over ``order`` would process before it has ``target`` pairs or has spent
    ``max_calls`` calls. At most max_calls / calls rows can be among them, so the running sum is
    over that many rows and not over the table."""
    w = W.orderBy(*order)
    first = df.orderBy(*order).limit(max_calls // calls + (max_calls % calls > 0))
    before = F.coalesce(F.sum(F.col(is_pair).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_before", before).where(F.col("_before") < target).drop("_before")


def caps(df: DataFrame, ratio_to_least: float = RATIO, floor: int = FLOOR, ratio_to_guardrail: float = GUARDRAIL_RATIO) -> DataFrame:
    """``(pair_type, n, cap)``: no type beyond the ratio to the least frequent one (or the floor);
    the dominant one also not beyond its ratio to all others together, if there are any."""
    c = df.where(F.col("pair_type").isNotNull()).groupBy("pair_type").agg(F.count("*").alias("n"))
    w = W.partitionBy(F.lit(1))
    least, others = F.min("n").over(w), F.sum(F.when(F.col("pair_type") != DOMINANT, F.col("n")).otherwise(0)).over(w)
    cap = F.greatest(F.lit(1), F.floor(F.greatest(least, F.lit(floor)) * ratio_to_least)).cast("long")
    guard = F.when(others > 0, F.greatest(F.lit(1), F.floor(others * ratio_to_guardrail)).cast("long")).otherwise(cap)
    return c.withColumn("cap", F.when(F.col("pair_type") == DOMINANT, F.least(cap, guard)).otherwise(cap))


def balance(df: DataFrame, key: str, seed: int = 42, **how: float) -> DataFrame:
    """At most ``cap`` rows of each type, drawn by hash."""
    quota = caps(df, **how).select("pair_type", F.col("cap").alias("quota"))
    return draw(df, "pair_type", quota, key, seed)


def oversample(df: DataFrame, times: int, key: str = "paragraph_id", dominant: str = DOMINANT) -> DataFrame:
    """Rows of other types ``times`` over, their key suffixed by the number of the copy. One copy
    leaves the table as it is; a null key stays null."""
    if times <= 1:
        return df
    copies = F.when(F.coalesce(F.col("pair_type"), F.lit("")) == dominant, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(times - 1)))
    out = df.withColumn("_copy", F.explode(copies))
    named = F.when(F.col("_copy") < 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("__dup"), F.col("_copy").cast("string")))
    return out.withColumn(key, named).drop("_copy")


def label_shares(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``(by, label, n, share)`` of a label column; missing labels are ``?``."""
    by = by or []
    c = df.groupBy(*by, F.coalesce(F.col(column), F.lit("?")).alias("label")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*(by or [F.lit(1)]))), 6))


def refuge_verdict(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Share of the label that uncertain judges fall back on, and whether it is beyond the limit."""
    got = df.groupBy(*by).agg(F.count_if(F.col(column) == REFUGE).alias("n_refuge"), F.count("*").alias("n"))
    return got.withColumn("share", ratio(F.col("n_refuge"), F.col("n"))).withColumn("high", F.col("share") > REFUGE_LIMIT)


def expected_yield(spark: SparkSession, candidates: DataFrame, epoch: str = "epoch") -> DataFrame:
    """``(epoch, n_candidates, n_expected)``: whole expected pairs of each period."""
    y = spark.createDataFrame(list(YIELDS.items()), f"{epoch} string, yield double")
    n = candidates.groupBy(epoch).agg(F.count("*").alias("n_candidates"))
    return F.broadcast(y).join(n, epoch, "left").select(epoch, F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.floor(F.coalesce("n_candidates", F.lit(0)) * F.col("yield") + 1e-9).cast("long").alias("n_expected"))


def numbered(df: DataFrame, order: list[str], name: str = "pair_id") -> DataFrame:
    """Adds sequential ids orpo_00000 and on, in the given order."""
    from .ranking import dense_id

    return dense_id(df, order, "_i").withColumn(name, F.format_string("orpo_%05d", F.col("_i"))).drop("_i")
