"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import cut, ship, table
from . import answers, encoding, leaks, lines, neardup, overlap, quota, scans, subjects, textform


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers of the preference pairs with their defect."""
    ship(spark)
    return answers.defective_answers(table(spark, d, "pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of corpus rows within one group of near-duplicates."""
    ship(spark)
    return neardup.group_pairs(cut(neardup.groups(table(spark, d, "corpus"))))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each corpus row that is in one."""
    ship(spark)
    return neardup.groups(table(spark, d, "corpus")).withColumnRenamed("group", "group_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Corpus values that are not in the consistent form."""
    ship(spark)
    return textform.findings(table(spark, d, "corpus").select("row_id", "content", "emetteur"), "row_id", ["content", "emetteur"])


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with content and issuer in the consistent form."""
    ship(spark)
    c = table(spark, d, "corpus").select("row_id", "content", "emetteur")
    return textform.normalise(c, ["content", "emetteur"], textform.fit(c, ["content", "emetteur"]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the corpus that recur across the documents of their issuer."""
    ship(spark)
    return lines.repeated_lines(table(spark, d, "corpus")).select("row_id", "line_no")


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Lines of clusters of near-equal lines that recur across the documents of their issuer."""
    ship(spark)
    return lines.repeated_lines(table(spark, d, "corpus"), exact=False).select("row_id", "line_no")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without these lines."""
    ship(spark)
    c = table(spark, d, "corpus")
    return lines.without_repeated_lines(c, lines.repeated_lines(c))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicates between training and evaluation splits."""
    ship(spark)
    return overlap.found(table(spark, d, "corpus"), table(spark, d, "splits"))


def p5_exact_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows and those equal to a training row after canonicalisation, by split and issuer."""
    ship(spark)
    return overlap.exact_overlaps(table(spark, d, "corpus"), table(spark, d, "splits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that cannot be met."""
    return quota.unmet(table(spark, d, "corpus"), table(spark, d, "targets"))


def p6_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Wanted, available and allocated rows of each target."""
    return quota.allocation(table(spark, d, "corpus"), table(spark, d, "targets")).drop("e", "t")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    """The sample drawn by these quotas."""
    return quota.draw(table(spark, d, "corpus"), table(spark, d, "targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of scanning noise in each corpus row."""
    ship(spark)
    return scans.scan_noise(table(spark, d, "corpus"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with this noise repaired."""
    ship(spark)
    return scans.repair(table(spark, d, "corpus"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of each document."""
    ship(spark)
    return encoding.token_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage of a held-out paragraph, and which."""
    ship(spark)
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "gold"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without these passages."""
    ship(spark)
    return leaks.remove_leaks(table(spark, d, "documents"), table(spark, d, "gold"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of each document."""
    ship(spark)
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
