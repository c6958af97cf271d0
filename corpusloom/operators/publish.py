"""Tables made ready for publication, and their quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import without
from .ranking import dense_id, first_of
from .taxonomy import EPOCHS


def clean(df: DataFrame, held_out: DataFrame | None = None, dedupe: bool = False) -> DataFrame:
    """Rows with content, without held-out paragraphs, renumbered from 0 last, so without gaps.
    ``source_row`` keeps the number they came with. ``dedupe`` keeps the first of each paragraph."""
    df = df.where(F.length(F.trim("content")) > 0).withColumnRenamed("row_id", "source_row")
    if held_out is not None:
        df = without(df, held_out, "paragraph_id")
    if dedupe:
        df = first_of(df, ["paragraph_id"], ["source_row"])
    return dense_id(df, ["paragraph_id", "source_row"], "row_id")


# The columns that an annotation round fills in, with their types and first values.
ANNOTATION_COLUMNS = {
    "csrd_category": ("string", None), "esrs_subcategory": ("string", None), "materialite_financiere": ("boolean", None), "materialite_impact": ("boolean", None), "materialite_score": ("int", None),
    "horizon_temporel": ("string", None), "market_surprise": ("string", None), "chain_of_thought": ("string", None), "final_answer_json": ("string", None), "annotateur": ("string", None),
    "prompt_version": ("string", "v1.0"), "confiance_annotation": ("double", None), "annotation_validated": ("boolean", False),
}


def with_annotation_columns(df: DataFrame) -> DataFrame:
    """``df`` with the columns of an annotation round; those it has stay as they are."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (t, v) in ANNOTATION_COLUMNS.items() if c not in df.columns})


def quality(df: DataFrame) -> DataFrame:
    """One row: rows, empty contents, distinct paragraphs, rows beyond the first of each, rows
    without epoch, rows of each known epoch, the mean length of content and, where there is a
    rationale, how many rows have one. One aggregation."""
    filled = [F.count_if(F.length(F.trim("chain_of_thought")) > 0).alias("n_rationale")] if "chain_of_thought" in df.columns else []
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.coalesce(F.length(F.trim("content")), F.lit(0)) == 0).alias("n_empty"),
        F.count_distinct("paragraph_id").alias("n_paragraphs"),
        (F.count("paragraph_id") - F.count_distinct("paragraph_id")).alias("n_repeated"),
        F.count_if(F.col("epoch").isNull()).alias("n_no_epoch"),
        F.round(F.avg(F.length("content")), 6).alias("mean_length"),
        *[F.count_if(F.trim("epoch") == e).alias(f"n_{e.replace('-', '_')}") for e in EPOCHS],
        *filled,
    )
