"""Stratification axes: period, document group, density quartile, and the stratum they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, text
from ..runtime import cut, spread
from . import quotas, ranking

RARE = 0.005


def type_shares(df: DataFrame, column: str = "type_document", rare: float = RARE) -> DataFrame:
    """``(doc_type, n, share, rare)``; null types are ``unknown``. As small as there are types."""
    t = df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))
    return t.withColumn("share", share).withColumn("rare", F.col("share") < rare)


def axes(df: DataFrame, quality: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """n_words, density, bucket, doc_group, quartile and stratum of the rows that pass the quality
    filter. The text is read once, in one expression: its features are materialised as narrow
    rows, from which the thresholds and type shares are taken as one-row and few-row side inputs.
    Columns in ``keep`` come along."""
    df = spread(df.select("row_id", *keep, "content", "type_document", "date_envoi"))
    df = df.select("row_id", *keep, F.coalesce("type_document", F.lit("unknown")).alias("doc_type"), dates.year_bucket(dates.year_of(F.col("date_envoi"))).alias("bucket"), text.scored(F.col("content"), quality).alias("s"))
    df = cut(df).where("s is not null").select("row_id", *keep, "doc_type", "bucket", "s.n_words", "s.density")
    cuts = df.agg(F.percentile("density", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"))
    rare = type_shares(df, "doc_type").where("rare").select("doc_type", F.lit(True).alias("is_rare"))
    out = df.crossJoin(F.broadcast(cuts)).join(rare, "doc_type", "left")
    group = F.when((text.bare(F.col("doc_type")) == "") | F.col("is_rare").isNotNull(), "other_doc").otherwise(text.bare(F.col("doc_type")))
    out = out.select("row_id", *keep, "n_words", "density", "bucket", group.alias("doc_group"), text.quartile_label(F.col("density"), F.col("cuts")).alias("quartile"))
    return out.withColumn("stratum", text.stratum_id(F.col("bucket"), F.col("doc_group"), F.col("quartile")))


def stratum_table(df: DataFrame) -> DataFrame:
    """Counts and means of each stratum. Densities are whole millionths and are summed as such, so
    the mean does not depend on the order of rows."""
    millionths = F.sum(F.round(F.col("density") * 1_000_000).cast("long"))
    return df.groupBy("bucket", "doc_group", "quartile").agg(F.count("*").alias("n"), F.round(millionths.cast("double") / F.count("*") / 1_000_000, 6).alias("mean_density"), F.round(F.avg("n_words"), 6).alias("mean_words"))


def pool(df: DataFrame, total: int, floor: int = 5, per_document: int = 6, seed: int = 42) -> DataFrame:
    """The stratified pool of a corpus: quality filter, axes, the ``per_document`` densest paragraphs
    of each document, quotas of the strata in proportion with a floor, and a seeded draw."""
    a = axes(df, keep=("document_id",))
    kept = cut(ranking.top_k(a, ["document_id"], [F.desc("density"), F.col("row_id")], per_document, "_k").drop("_k"))
    quota = quotas.reduced(kept.groupBy("stratum").agg(F.count("*").alias("size")), total, floor)
    return ranking.draw(kept, "stratum", quota.select("stratum", "quota"), "row_id", seed)
