"""Quotas over strata. A table of strata is small by nature; rows are never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Shares of candidates by period.
CANDIDATE_WEIGHTS = {"2010-2014": 0.40, "2015-2019": 0.30, "2020-2022": 0.20, "2023-2026": 0.10}

MOST_STRATA = 1_000_000  # that exact quotas are computed for on the driver


def proportional(sizes: DataFrame, total: int, floor: int) -> DataFrame:
    """Adds ``quota``: the share of ``total`` cut to a whole number, at least ``floor``, at most
    the size. The sum may be less or more than the total; ``exact`` meets it."""
    share = F.floor(total * F.col("size") / F.sum("size").over(W.partitionBy(F.lit(1))).cast("double")).cast("long")
    return sizes.withColumn("quota", F.least("size", F.greatest(F.lit(floor).cast("long"), share)))


def reduced(sizes: DataFrame, total: int, floor: int) -> DataFrame:
    """As ``proportional``; if the floors make the quotas sum to more than the total, those above
    the floor give the excess back in proportion to their size, never below the floor."""
    q = proportional(sizes, total, floor)
    w = W.partitionBy(F.lit(1))
    over = F.sum("quota").over(w) - total
    above = F.col("quota") > floor
    cut = F.floor(over * F.col("quota") / F.sum(F.when(above, F.col("quota"))).over(w).cast("double"))
    return q.withColumn("quota", F.when((over > 0) & above, F.greatest(F.lit(floor), F.col("quota") - cut)).otherwise(F.col("quota")).cast("long"))


def weighted(spark: SparkSession, weights: dict[str, float], n: int, part: str = "epoch") -> DataFrame:
    """``(part, quota)``: whole shares of n, at least 1."""
    return spark.createDataFrame([(k, max(1, int(n * w + 1e-6))) for k, w in weights.items()], f"{part} string, quota long")


def level(start: dict[str, int], room: dict[str, int], amount: int) -> dict[str, int]:
    """``amount`` steps handed out in turns, largest room first, one step a turn to each that has
    room left; in closed form: how many full turns fit, then one more to the first."""
    order = sorted((s for s in room if room[s] > 0), key=lambda s: (-room[s], s))
    amount = min(amount, sum(room[s] for s in order))
    lo, hi = 0, max((room[s] for s in order), default=0)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(min(room[s], mid) for s in order) <= amount else (lo, mid - 1)
    out = {s: start[s] + min(room.get(s, 0), lo) for s in start}
    left = amount - sum(min(room[s], lo) for s in order)
    for s in [s for s in order if room[s] > lo][:left]:
        out[s] += 1
    return out


def allocate(sizes: dict[str, int], total: int, floor: int) -> dict[str, int]:
    """Quotas that sum to ``total`` where sizes and floors allow: rounded shares between floor and
    size, then evened out in turns, largest first. Nothing goes below the floor or above the size."""
    whole = sum(sizes.values())
    if not whole:
        return dict.fromkeys(sizes, 0)
    quota = {s: min(max(floor, round(total * n / whole)), n) for s, n in sizes.items()}
    over = sum(quota.values()) - total
    if over > 0:
        cuts = level(dict.fromkeys(quota, 0), {s: q - floor for s, q in quota.items() if q > floor}, over)
        return {s: q - cuts[s] for s, q in quota.items()}
    return level(quota, {s: sizes[s] - q for s, q in quota.items()}, -over)


def exact(sizes: DataFrame, total: int, floor: int) -> DataFrame:
    """``(stratum, size, quota)`` by ``allocate``, over the collected sizes of the strata."""
    some = sizes.select("stratum", "size").limit(MOST_STRATA + 1).collect()
    if len(some) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata: take reduced(), which never collects")
    rows = {r["stratum"]: r["size"] for r in some}
    got = allocate(rows, total, floor)
    return sizes.sparkSession.createDataFrame([(s, n, got[s]) for s, n in rows.items()], "stratum string, size long, quota long")
