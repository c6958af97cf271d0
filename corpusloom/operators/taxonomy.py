"""The closed code lists of the sustainability taxonomy, as expressions and small tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories in order with their pillar and French label.
CATEGORIES = [
    ("none", "none", "Aucune pertinence CSRD"),
    ("ESRS2", "general", "Informations générales (gouvernance, stratégie, IRO)"),
    ("E1", "environment", "Changement climatique"),
    ("E2", "environment", "Pollution"),
    ("E3", "environment", "Eau et ressources marines"),
    ("E4", "environment", "Biodiversité et écosystèmes"),
    ("E5", "environment", "Utilisation des ressources et économie circulaire"),
    ("S1", "social", "Effectifs propres"),
    ("S2", "social", "Travailleurs de la chaîne de valeur"),
    ("S3", "social", "Communautés affectées"),
    ("S4", "social", "Consommateurs et utilisateurs finaux"),
    ("G1", "governance", "Conduite des affaires"),
]
# The disclosure codes of each category.
SUBCODES = {
    "none": ["none"],
    "ESRS2": ["ESRS2-GOV", "ESRS2-SBM", "ESRS2-IRO", "ESRS2-MDR"],
    "E1": ["E1-1", "E1-2", "E1-3", "E1-4", "E1-5", "E1-6", "E1-7", "E1-8", "E1-9"],
    "E2": ["E2-1", "E2-2", "E2-3", "E2-4", "E2-5", "E2-6"],
    "E3": ["E3-1", "E3-2", "E3-3", "E3-4", "E3-5"],
    "E4": ["E4-1", "E4-2", "E4-3", "E4-4", "E4-5"],
    "E5": ["E5-1", "E5-2", "E5-3", "E5-4", "E5-5", "E5-6"],
    "S1": ["S1-1", "S1-2", "S1-3", "S1-4", "S1-5", "S1-6", "S1-7", "S1-8", "S1-9", "S1-10", "S1-11", "S1-12", "S1-13", "S1-14", "S1-15", "S1-16", "S1-17"],
    "S2": ["S2-1", "S2-2", "S2-3", "S2-4", "S2-5"],
    "S3": ["S3-1", "S3-2", "S3-3", "S3-4", "S3-5"],
    "S4": ["S4-1", "S4-2", "S4-3", "S4-4", "S4-5"],
    "G1": ["G1-1", "G1-2", "G1-3", "G1-4", "G1-5", "G1-6"],
}
# Ordinal scales.
SURPRISE = ["aucune", "faible", "partielle", "forte"]
HORIZONS = ["immediat", "court_terme", "moyen_terme", "long_terme"]
EPOCHS = ["2010-2014", "2015-2019", "2020-2022", "2023-2026"]

CODES = [c for c, _, _ in CATEGORIES]


def pillar(code: Column) -> Column:
    """The pillar of a category; unknown and null codes are ``unknown``."""
    return reduce(lambda e, x: e.when(code == x[0], x[1]), CATEGORIES, F.when(F.lit(False), None)).otherwise("unknown")


def subcodes(code: Column) -> Column:
    """The array of disclosure codes of a category, null for an unknown one."""
    return reduce(lambda e, c: e.when(code == c, F.array(*map(F.lit, SUBCODES[c]))), CODES, F.when(F.lit(False), None)).otherwise(F.lit(None).cast("array<string>"))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "code string, pillar string, label_fr string")


def rank(scale: list[str], value: Column) -> Column:
    """Place of a value on an ordinal scale from 0; null for what is not on it."""
    place = F.array_position(F.array(*map(F.lit, scale)), value)
    return F.when(place > 0, place - 1)


def annotation_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors``, the rules that an annotation breaks, in order; an invalid category is the
    only one reported for its row. Columns: csrd_category, esrs_subcategory, materialite_score,
    materialite_financiere, materialite_impact, market_surprise, horizon_temporel,
    chain_of_thought, confiance_annotation. Nulls break the rules that want a value.
    """
    cat, score, sub = F.col("csrd_category"), F.col("materialite_score"), F.col("esrs_subcategory")
    none = cat == "none"
    in_range = score.between(0, 5)

    def rule(bad: Column, name: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))

    rules = [
        rule(~in_range, "materialite_score invalide"),
        F.when(in_range & none & (score != 0), F.lit("materialite_score doit être 0")),
        F.when(in_range & ~none & (score == 0), F.lit("materialite_score incohérent")),
        F.when(none & ~F.coalesce(sub, F.lit("none")).isin("none"), F.lit("esrs_subcategory doit être null")),
        F.when(~none & ~F.coalesce(F.array_contains(subcodes(cat), sub), F.lit(False)), F.lit("esrs_subcategory invalide")),
        *[x for c in ("materialite_financiere", "materialite_impact") for x in (F.when(F.col(c).isNull(), F.lit(f"{c} doit être un booléen")), F.when(none & F.col(c), F.lit(f"{c} doit être False")))],
        rule(~F.col("market_surprise").isin(SURPRISE), "market_surprise invalide"),
        F.when(none & F.col("horizon_temporel").isNotNull(), F.lit("horizon_temporel doit être null")),
        F.when(~none & ~F.coalesce(F.col("horizon_temporel").isin(HORIZONS), F.lit(False)), F.lit("horizon_temporel invalide")),
        rule(F.length(F.trim("chain_of_thought")) < 10, "chain_of_thought trop court"),
        F.when(~F.col("confiance_annotation").between(0, 1), F.lit("confiance_annotation invalide")),
    ]
    broken = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return df.withColumn("errors", F.when(F.coalesce(cat.isin(CODES), F.lit(False)), broken).otherwise(F.array(F.lit("csrd_category invalide"))))


def batch_report(df: DataFrame) -> DataFrame:
    """``(error, n)`` over rows with an ``errors`` column, plus the number of valid rows as ``valide``."""
    one = df.select(F.explode(F.when(F.size("errors") == 0, F.array(F.lit("valide"))).otherwise(F.col("errors"))).alias("error"))
    return one.groupBy("error").agg(F.count("*").alias("n"))


def first_invalid(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """``(key, errors)`` of the first n rows that break a rule."""
    return df.where(F.size("errors") > 0).select(key, "errors").orderBy(key).limit(n)
