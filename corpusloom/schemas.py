"""Schemas of the logical tables, and the projection that brings a source to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public names of columns and the internal names they become.
PUBLIC_TO_INTERNAL = {"document_id": "article_id", "date_envoi": "publish_date", "type_document": "doc_type", "emetteur": "author"}
CORPUS = "row_id bigint, paragraph_id string, document_id string, content string, date_envoi date, emetteur string, type_document string, epoch string"
GOLD = CORPUS + ", csrd_category string, esrs_subcategory string, chain_of_thought string"
PAIR = "pair_id string, paragraph_id string, epoch string, pair_type string, prompt string, chosen string, rejected string, chosen_category string, rejected_category string, chosen_model string, rejected_model string"


def normalise(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Exactly the wanted columns: of the source names listed for each, the present one with most
    values (ties to the first listed), or a null string column if none is there."""
    have = set(df.columns)
    rivals = sorted({s for names in wanted.values() if len([n for n in names if n in have]) > 1 for s in names if s in have})
    counts = df.agg(*[F.count(c).alias(c) for c in rivals]).first().asDict() if rivals else {}
    out = []
    for target, names in wanted.items():
        present = [n for n in dict.fromkeys(names) if n in have]
        best = max(present, key=lambda n: (counts.get(n, 0), -present.index(n))) if present else None
        out.append(F.col(best).alias(target) if best else F.lit(None).cast("string").alias(target))
    return df.select(*out)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def to_internal(df: DataFrame) -> DataFrame:
    """Public names become internal ones where the internal name is not taken yet."""
    return df.withColumnsRenamed({k: v for k, v in PUBLIC_TO_INTERNAL.items() if v not in df.columns})
