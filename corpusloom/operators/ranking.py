"""Top-k, draws, splits and ids. Draws are in the order of the md5 of id and seed, so they are the
same on every engine and every run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut


def shuffled(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def top_k(df: DataFrame, part: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each part. Spark cuts each map's groups to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*part).orderBy(*order))).where(F.col(name) <= k)


def first_of(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    return top_k(df, part, order, 1, "_r").drop("_r")


def _placed(df: DataFrame, part: list[str], key: str, seed: int) -> DataFrame:
    """Adds ``_place``, the place of a row in the drawing order of its part, and ``_size``, the
    rows of the part, without sorting a part in one task: the two first hex digits of the hash make
    256 ranges, whose counts are summed. Parts are compared as structs, so null is a part."""
    df = df.withColumn("_h", shuffled(key, seed)).withColumn("_b", F.substring("_h", 1, 2)).withColumn("_k", F.struct(*part))
    w = W.partitionBy("_k")
    before = df.groupBy("_k", "_b").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_size", F.sum("_n").over(w)).drop("_n")
    joined = df.join(before, ["_k", "_b"])
    placed = joined.withColumn("_place", F.col("_before") + F.row_number().over(W.partitionBy("_k", "_b").orderBy("_h", key)))
    return placed.drop("_h", "_b", "_k", "_before")


def draw(df: DataFrame, part: str, quota: DataFrame, key: str, seed: int) -> DataFrame:
    """As many rows of each part as ``quota`` (part, quota) says, or all it has. Parts without a
    quota and null parts give none."""
    got = _placed(df.join(F.broadcast(quota), part), [part], key, seed)
    return got.where("_place <= quota").drop("_place", "_size", "quota")


def round_robin(df: DataFrame, part: str, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each part, one from each group in turn."""
    a = top_k(df, [part, group], [shuffled(key, seed), key], n, "_turn")
    return top_k(a, [part], ["_turn", shuffled(group, seed), group], n, "_k").drop("_turn", "_k")


def round_robin_quota(df: DataFrame, part: str, group: str, key: str, quota: DataFrame, seed: int) -> DataFrame:
    """As ``round_robin`` with the number of rows of each part from ``quota`` (part, quota)."""
    most = quota.agg(F.max("quota")).first()[0] or 0  # so that each map can cut its groups before the shuffle
    a = top_k(df.join(F.broadcast(quota), part), [part, group], [shuffled(key, seed), key], int(most), "_turn").where("_turn <= quota")
    k = F.row_number().over(W.partitionBy(part).orderBy("_turn", shuffled(group, seed), group))
    return a.withColumn("_k", k).where("_k <= quota").drop("_turn", "_k", "quota")


def split(df: DataFrame, part: list[str], key: str, share: float, seed: int) -> DataFrame:
    """Adds ``part`` train or val: of each stratum the rounded share, at least one, goes to
    validation, and at least one row stays in training."""
    n = F.col("_size")
    take = F.least(n - 1, F.greatest(F.lit(1), F.round(n * share).cast("long")))
    placed = _placed(df, part, key, seed)
    return placed.withColumn("part", F.when(F.col("_place") <= take, "val").otherwise("train")).drop("_place", "_size")


def one_of_each(df: DataFrame, column: str, order: list[str], n: int) -> DataFrame:
    """The first row of each of the n first values."""
    return first_of(df.where(F.col(column).isNotNull()), [column], order).orderBy(column).limit(n)


def padded(df: DataFrame, order: list[str], defaults: DataFrame, default_order: list[str], n: int) -> DataFrame:
    """At most n rows with their ``place`` from 1: those of ``df`` in order, then as many of the
    defaults as are missing. Both are small."""
    columns = [c for c in df.columns if c in defaults.columns]
    tagged = [x.select(F.lit(i).alias("_s"), F.row_number().over(W.orderBy(*o)).alias("_i"), *columns) for i, (x, o) in enumerate(((df.orderBy(*order).limit(n), order), (defaults, default_order)))]
    both = tagged[0].unionByName(tagged[1]).orderBy("_s", "_i").limit(n)
    return both.withColumn("place", F.row_number().over(W.orderBy("_s", "_i"))).drop("_s", "_i")


def pick_by_priority(subsets: list[DataFrame], key: str, each: int, total: int) -> DataFrame:
    """``(key, priority)``: at most ``each`` rows of each subset, a row under its first subset."""
    tagged = [s.orderBy(key).limit(each).select(key, F.lit(i + 1).cast("long").alias("priority")) for i, s in enumerate(subsets)]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.min("priority").alias("priority")).orderBy("priority", key).limit(total)


def dense_id(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers from 0 in the order of columns that tell all rows apart. The order columns alone are
    range-sorted and materialised, so that places and partition sizes are of one and the same sort;
    no partition holds everything. The numbers are then joined to the rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.struct(*order).alias("_k")).repartitionByRange(parts, "_k").sortWithinPartitions("_k")
    keys = cut(keys.select("_k", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    sizes = keys.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbers = keys.join(F.broadcast(before), "_p").select("_k", (F.col("_before") + F.col("_i")).alias(name))
    return df.withColumn("_k", F.struct(*order)).join(numbers, "_k").drop("_k")


def shuffle(df: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """Adds the place of each row in the seeded order, from 1."""
    s = df.withColumn("_h", shuffled(key, seed))
    return dense_id(s, ["_h", key], "_d").withColumn(name, F.col("_d") + 1).drop("_h", "_d")


def arg_max(df: DataFrame, value: str, by: str) -> DataFrame:
    """The row of the greatest ``by``; ties to the least value."""
    return df.orderBy(F.desc(by), value).limit(1)
