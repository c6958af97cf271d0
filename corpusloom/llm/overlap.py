"""Problem 5: records of evaluation splits that also stand, exactly or almost, in training.

Records are canonicalised (consistent form, case, punctuation, white space) and hashed; equal
hashes are exact overlaps, counted by split and source after aggregation on both sides. Almost
equal records come from the near-duplicate groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .neardup import members
from .textform import consistent_col

TRAIN, EVALUATION = "train", ("validation", "test")


def clean_split(c: Column) -> Column:
    """A split name in lower case without blanks."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def split_of(splits: DataFrame) -> DataFrame:
    """``(row_id, split)`` once each; null ids and null splits are left out."""
    return splits.select("row_id", clean_split(F.col("split")).alias("split")).where("row_id is not null and split is not null").distinct()


def canonical_hash(content: Column) -> Column:
    """64 bits of the words of a text in order; null and wordless texts give null."""
    words = F.regexp_extract_all(F.lower(consistent_col(content)), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.when(F.size(words) > 0, F.xxhash64(F.array_join(words, " ")))


def exact_overlaps(df: DataFrame, splits: DataFrame) -> DataFrame:
    """``(split, emetteur, rows, leaked)``: evaluation rows by split and source, and how many of
    them have the canonical hash of a training row. Null sources form a source of their own; rows
    without words are in ``rows`` but never leak.
    """
    hashed = df.select("row_id", consistent_col(F.col("emetteur")).alias("emetteur"), canonical_hash(F.col("content")).alias("h")).join(split_of(splits), "row_id")
    train = hashed.where((F.col("split") == TRAIN) & F.col("h").isNotNull()).select("h").distinct().withColumn("hit", F.lit(1))
    held = hashed.where(F.col("split").isin(*EVALUATION)).groupBy("split", "emetteur", "h").agg(F.count("*").alias("n"))
    out = held.join(train, "h", "left").groupBy("split", "emetteur")
    return out.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.col("n") * F.col("hit")), F.lit(0)).cast("long").alias("leaked"))


def overlaps(members: DataFrame, splits: DataFrame) -> DataFrame:
    """``(row_id_a, row_id_b, split)``: pairs of one group with one row in training and the other
    in an evaluation split, which is ``split``. Rows without a split are in no pair.

    Evaluation hashes of canonical rows are joined with training hashes first; rows that are only
    almost equal meet by their group, without those that met by their hash.
    """
    tagged = members.join(split_of(splits), "row_id")
    train = tagged.where(F.col("split") == TRAIN).select("whole", "group", F.col("row_id").alias("t"))
    held = tagged.where(F.col("split").isin(*EVALUATION)).select("whole", "group", F.col("row_id").alias("e"), "split")
    exact = held.join(train.drop("group"), "whole").select("t", "e", "split")
    almost = held.join(train.withColumnRenamed("whole", "other"), "group").where("whole <> other").select("t", "e", "split")
    both = exact.unionByName(almost).where("t <> e")
    return both.select(F.least("t", "e").alias("row_id_a"), F.greatest("t", "e").alias("row_id_b"), "split").distinct()


def found(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Cross-split overlaps of the whole collection; see ``neardup.members`` for nulls and short rows."""
    return overlaps(cut(members(df)), splits)
