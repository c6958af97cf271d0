"""Problem 6: a sample whose shares follow target proportions, by a category tree.

The tree is root, period, type. Wanted rows come down from the root by share and minimum; what
a leaf cannot give goes to its siblings with rows to spare, in proportion, then to its cousins.
Rows are drawn at the leaves by the dense rank of a permutation (a seeded hash): the counts of
hash ranges tell in which range the quota of a leaf ends; lower ranges are taken whole and only
that one is ranked, so the rows of a leaf are neither moved nor sorted as a whole. Everything
beside the draw has one row per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut

OTHER_TYPE = "other_doc"
DIGITS = 3  # hex digits of a hash that make a range, so 4096 ranges a leaf


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def epoch_key(c: Column) -> Column:
    return _bare(c)


def type_key(c: Column) -> Column:
    """A type without outer blanks and case; null and blank are one type of their own."""
    bare = F.lower(_bare(c))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(OTHER_TYPE)).otherwise(bare)


def _shares(part: list[str], pool: str, spare: str) -> Column:
    """Whole numbers that split ``pool`` in proportion to ``spare`` within ``part``, by largest
    remainder; a pool beyond all that is spare is cut to it."""
    w = W.partitionBy(*part)
    total = F.sum(spare).over(w)
    pool_ = F.least(F.col(pool), total)
    exact = F.when(total > 0, pool_ * F.col(spare)).otherwise(0)
    base = F.when(total > 0, F.floor(exact / F.greatest(total, F.lit(1)))).otherwise(0).cast("long")
    rest = exact - base * total
    order = F.row_number().over(w.orderBy(rest.desc(), "e", "t"))
    return (base + F.when((order <= pool_ - F.sum(base).over(w)) & (rest > 0), 1).otherwise(0)).cast("long")


def allocation(df: DataFrame, targets: DataFrame, share: int = 5, epoch: str = "epoch", kind: str = "type_document") -> DataFrame:
    """One row per target: its keys e and t, epoch and type as spelled, wanted, available, quota.

    With n the rows of ``df``, floor(n / share) rows are wanted in all; a leaf wants the greater
    of ``min_rows`` and its ``target_bp`` ten-thousandths. Null ``target_bp`` or ``min_rows``
    count as 0. Rows with null epoch belong to no leaf. Targets that are the same leaf by
    their keys are each measured against all its rows, and share them in the draw in order of
    spelling. Empty ``df``: every quota is 0; empty ``targets``: no rows.
    """
    n = df.agg(F.count("*").alias("n"))
    keys = df.select(epoch_key(F.col(epoch)).alias("e"), type_key(F.col(kind)).alias("t"))
    counts = keys.where("e is not null").groupBy("e", "t").agg(F.count("*").alias("available"))
    t = targets.select(F.col(epoch).alias("epoch"), F.col(kind).alias("type_document"), epoch_key(F.col(epoch)).alias("e"), type_key(F.col(kind)).alias("t"), F.coalesce("target_bp", F.lit(0)).cast("long").alias("bp"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("least"))
    t = t.distinct().crossJoin(F.broadcast(n))
    t = t.withColumn("wanted", F.greatest("least", F.floor(F.col("bp") * F.floor(F.col("n") / share) / 10000)).cast("long"))
    # from here on one row per target, so the windows need no shuffles among tasks
    t = t.join(counts, ["e", "t"], "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long")).coalesce(1)
    same = W.partitionBy("e", "t").orderBy("epoch", "type_document").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("free", F.greatest(F.lit(0), F.col("available") - F.coalesce(F.sum("wanted").over(same), F.lit(0))).cast("long"))
    t = t.withColumn("own", F.least("wanted", "free")).withColumn("first", F.row_number().over(W.partitionBy("e", "t").orderBy("epoch", "type_document")) == 1)
    t = t.withColumn("spare", F.when(F.col("first"), F.greatest(F.lit(0), F.col("available") - F.sum("own").over(W.partitionBy("e", "t")))).otherwise(0).cast("long"))
    t = t.withColumn("unmet", F.sum(F.col("wanted") - F.col("own")).over(W.partitionBy("e")))
    t = t.withColumn("sibling", _shares(["e"], "unmet", "spare")).withColumn("spare", F.col("spare") - F.col("sibling"))
    t = t.withColumn("left", F.col("unmet") - F.sum("sibling").over(W.partitionBy("e"))).withColumn("one", F.lit(1))
    t = _pool(t)
    t = t.withColumn("cousin", _shares(["one"], "pool", "spare"))
    return t.select("e", "t", "epoch", "type_document", "wanted", "available", (F.col("own") + F.col("sibling") + F.col("cousin")).alias("quota"))


def _pool(t: DataFrame) -> DataFrame:
    """What whole periods could not place among siblings, to be placed among cousins."""
    t = t.withColumn("k", F.row_number().over(W.partitionBy("e").orderBy("t", "epoch", "type_document")))
    return t.withColumn("pool", F.sum(F.when(F.col("k") == 1, F.col("left")).otherwise(0)).over(W.partitionBy("one")).cast("long"))


def unmet(df: DataFrame, targets: DataFrame, share: int = 5) -> DataFrame:
    """``(epoch, type_document)`` of the targets that have fewer rows than they want, from the
    allocation down the tree: one row per target, materialised."""
    return cut(allocation(df, targets, share)).where("available < wanted").select("epoch", "type_document").distinct()


def draw(df: DataFrame, targets: DataFrame, share: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``(row_id, epoch, type_document)`` of the sampled rows, the same for the same seed: those
    with the least md5 of key and seed.

    Equal hashes and repeated keys are told apart by the key only, so rows that are equal in all
    of them may replace each other. No row is drawn twice.
    """
    quota = allocation(df, targets, share).groupBy("e", "t").agg(F.sum("quota").alias("quota")).where("quota > 0")
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    rows = df.select(key, "epoch", "type_document", epoch_key(F.col("epoch")).alias("e"), type_key(F.col("type_document")).alias("t"), h.alias("h"))
    rows = rows.where("e is not null").withColumn("r", F.substring("h", 1, DIGITS))
    counts = rows.groupBy("e", "t", "r").agg(F.count("*").alias("n")).join(F.broadcast(quota), ["e", "t"])
    before = F.coalesce(F.sum("n").over(W.partitionBy("e", "t").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("before", before).where("before < quota").groupBy("e", "t").agg(F.max("r").alias("end"), F.max_by(F.col("quota") - F.col("before"), "r").alias("rest"))
    near = rows.join(F.broadcast(cut(ends)), ["e", "t"]).where("r <= end")
    place = F.row_number().over(W.partitionBy("e", "t").orderBy("h", key))
    ranked = near.where("r = end").withColumn("rank", place).where("rank <= rest")
    return near.where("r < end").select(key, "epoch", "type_document").unionByName(ranked.select(key, "epoch", "type_document"))
