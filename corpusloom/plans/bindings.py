"""Logical entities over the test tables, in SQL that every engine reads alike.

``bind(spark, folder, "predictions")`` is a DataFrame; ``cte("predictions")`` is the same as a
common table expression for an oracle. Labels and errors that the tables lack are arithmetic on
row_id, so both sides agree without random numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.taxonomy import CODES, EPOCHS, HORIZONS, SURPRISE
from ..runtime import table


def pick(values: list[str], number: str) -> str:
    """SQL for the value at a number from 0."""
    return f"case {number} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


VIEWS = {
    # three models' labels beside a gold label, with malformed (null) and failed predictions
    "predictions": f"""
        select row_id, trim(epoch) as epoch, content, emetteur, concat('m', cast(m as string)) as model, gold as gold_label,
            case when h < 9 then gold when h < 12 then 'none' when h < 14 then {pick(CODES, "(row_id + m) % 12")} when h = 14 then null else 'E1' end as pred_label,
            case when (row_id + m) % 29 = 0 then 'timeout' when (row_id + m) % 31 = 0 then ' ' end as error
        from (select *, (row_id * (2 * m + 5) + m * 7) % 17 as h,
                case when row_id % 10 < 6 then 'none' else {pick(CODES, "row_id % 12")} end as gold
            from {{corpus}} cross join (select 1 as m union all select 2 union all select 3) models) p""",
    # three models' labels of the held-out rows, mostly right
    "gold_predictions": f"""
        select row_id, csrd_category as gold_label, concat('m', cast(m as string)) as model,
            case when (row_id * (2 * m + 1) + m) % 19 = 0 then 'none' when (row_id + 3 * m) % 23 = 0 then 'E1' else csrd_category end as pred_label
        from {{gold}} cross join (select 1 as m union all select 2 union all select 3) models where csrd_category is not null""",
    # two annotators of the same rows
    "annotations": f"""
        select row_id, content, who, csrd_category, concat(csrd_category, '-', cast(k % 7 as string)) as esrs_subcategory,
            case when csrd_category = 'none' then 0 else (row_id * 7 + k) % 6 end as score,
            case when (row_id + k) % 4 = 0 then 'oui' when (row_id + k) % 4 = 1 then 'Non' when (row_id + k) % 4 = 2 then '1' else '' end as financial,
            case when (row_id * 2 + k) % 5 < 2 then 'vrai' when (row_id * 2 + k) % 5 < 4 then 'faux' end as impact,
            {pick(SURPRISE, "(row_id * 3 + k) % 4")} as surprise,
            case when (row_id + k) % 11 = 0 then null else {pick(HORIZONS, "(row_id + k) % 4")} end as horizon
        from (select *, case when row_id % 5 < 2 then 'none' else {pick(CODES, "(row_id + k) % 12")} end as csrd_category
            from (select row_id, content, who, case when who = 'human' then 0 when row_id % 3 = 0 then 1 else 0 end as k
                from {{corpus}} cross join (select 'human' as who union all select 'model') w
                where not (who = 'human' and row_id % 13 = 0) and not (who = 'model' and row_id % 17 = 0)) a) b""",
    # full annotation objects, many of them against the rules
    "objects": f"""
        select row_id, {pick([*CODES, "X9"], "row_id % 13")} as csrd_category,
            case when row_id % 13 = 0 then case when row_id % 2 = 0 then null else 'E1-1' end else concat({pick([*CODES, "X9"], "row_id % 13")}, '-', cast(row_id % 8 as string)) end as esrs_subcategory,
            cast((row_id * 3) % 8 - 1 as int) as materialite_score,
            case when row_id % 7 = 0 then null when row_id % 7 < 4 then true else false end as materialite_financiere,
            case when row_id % 5 = 0 then null when row_id % 5 < 3 then false else true end as materialite_impact,
            {pick([*SURPRISE, "énorme"], "row_id % 5")} as market_surprise,
            case when row_id % 6 = 0 then null else {pick([*HORIZONS, "jamais"], "row_id % 5")} end as horizon_temporel,
            case when row_id % 9 = 0 then 'court' else content end as chain_of_thought,
            case when row_id % 4 = 0 then null else cast((row_id % 12) as double) / 10 end as confiance_annotation
        from {{corpus}}""",
    # rows of a metadata export, everything a string
    "metadata": """
        select row_id, case row_id % 8 when 0 then 'OUI' when 1 then ' x ' when 2 then '1' when 3 then 'non' when 4 then 'Vrai' when 5 then '0' when 6 then null else 'yes' end as member,
            case row_id % 7 when 0 then 'FR' when 1 then ' fr ' when 2 then 'en' when 3 then null else 'Français' end as lang,
            case row_id % 6 when 0 then cast(date_envoi as string) when 1 then concat(substring(cast(date_envoi as string), 9, 2), '/', substring(cast(date_envoi as string), 6, 2), '/', substring(cast(date_envoi as string), 1, 4))
                when 2 then replace(cast(date_envoi as string), '-', '') when 3 then 'sans date' when 4 then ' 2012-13-45 ' else concat(cast(date_envoi as string), ' 10:00') end as published,
            case when row_id % 11 = 0 then '  ' when row_id % 12 = 0 then null else concat(' https://site/', document_id, '/', cast(row_id % 50 as string), ' ') end as url,
            document_id, emetteur
        from {corpus}""",
    # paragraphs of a pool with year and stratum
    "pool": """
        select row_id, paragraph_id, document_id, content, emetteur, trim(epoch) as epoch,
            case when type_document is null or trim(type_document) = '' then 'other_doc' else trim(type_document) end as doc_group,
            (row_id * 37) % 101 as score from {corpus} where content is not null""",
    # candidates of preference pairs with two models' labels
    "candidates": f"""
        select row_id, trim(epoch) as epoch, content,
            {pick(CODES, "(row_id * 5) % 12")} as silver,
            case when row_id % 3 = 0 then {pick(CODES, "(row_id * 5) % 12")} when row_id % 3 = 1 then 'none' else {pick(CODES, "(row_id * 7 + 1) % 12")} end as base
        from {{corpus}}""",
    # processed urls with their outcome
    "ledger": """
        select row_id, document_id, case when row_id % 10 < 7 then 'done' when row_id % 10 < 9 then 'failed' end as status,
            case when row_id % 10 = 7 then 'http_404' when row_id % 10 = 8 then 'timeout' end as error_code
        from {corpus}""",
    # web pages
    "pages": """
        select doc_id, concat('<html><head><style>p x</style></head><body><nav>menu</nav><h1>Titre ', cast(doc_id as string), '</h1><p>',
            replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '</p><script>var a = 1;</script><footer>pied</footer></body></html>') as html
        from {documents}""",
}
SOURCES = {"pages": "documents", "gold_predictions": "gold"}


def _of(name: str) -> str:
    return SOURCES.get(name, "corpus")


def bind(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A logical entity, or a table of that name."""
    if name not in VIEWS:
        return table(spark, folder, name)
    return spark.sql(VIEWS[name], **{_of(name): table(spark, folder, _of(name))})


def cte(*names: str) -> str:
    """``with`` clause of logical entities for an oracle."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n].format(**{_of(n): _of(n)})})" for n in names)


__all__ = ["EPOCHS", "bind", "cte", "pick"]
