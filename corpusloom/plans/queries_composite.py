"""Chains of operators that belong together: selection of a gold set, training data, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, jsonx, text
from ..operators import filters, joins, metrics, models, pairs, quotas, ranking, strata
from ..runtime import cut
from .bindings import bind, cte
from .queries_metrics import CELLS, OK, SCORES
from .queries_pairs import Q, _get, _valid
from .queries_relational import drawn, exact_sql
from .queries_text import BUCKET, STRATA
from .registry import query


@query("gold_selection", cte("pool") + f""", p as (select * from pool where epoch is not null), z as (select epoch as stratum, count(*) as size from p group by epoch), {exact_sql('z', 140, 5, 'q')},
    t as (select p.row_id, p.epoch, p.doc_group, quota, row_number() over (partition by p.epoch, p.doc_group order by {drawn('p.row_id')}, p.row_id) as turn from p join q on p.epoch = q.stratum),
    k as (select *, row_number() over (partition by epoch order by turn, {drawn('doc_group')}, doc_group) as k from t where turn <= quota), g as (select row_id, epoch, doc_group from k where k <= quota),
    y as (select epoch as stratum, count(*) as size from g group by epoch), {exact_sql('y', 40, 5, 'v')},
    s as (select g.*, v.quota, row_number() over (partition by g.epoch order by md5(concat_ws(':', cast(g.row_id as varchar), '43')), g.row_id) as place from g join v on g.epoch = v.stratum)
    select row_id, epoch, doc_group, place <= quota as iaa_subset from s""")
def gold_selection(spark, d):
    """140 rows by exact quotas per period, spread over document groups, 40 of them for agreement."""
    pool = bind(spark, d, "pool").where("epoch is not null")
    sizes = pool.groupBy(F.col("epoch").alias("stratum")).agg(F.count("*").alias("size"))
    gold = ranking.round_robin_quota(pool, "epoch", "doc_group", "row_id", quotas.exact(sizes, 140, 5).select(F.col("stratum").alias("epoch"), "quota"), 42)
    again = gold.groupBy(F.col("epoch").alias("stratum")).agg(F.count("*").alias("size"))
    shared = ranking.draw(gold, "epoch", quotas.exact(again, 40, 5).select(F.col("stratum").alias("epoch"), "quota"), "row_id", 43)
    return joins.flag(gold, shared, "row_id", "iaa_subset").select("row_id", "epoch", "doc_group", "iaa_subset")


_HELD = "(select c.paragraph_id from corpus c join splits s on c.row_id = s.row_id where lower(trim(s.split)) = 'test' and c.paragraph_id is not null)"
_TRIM = "trim(chosen, ' ' || chr(10))"
_OK = f"{_TRIM} like '{{%' and {_valid(_TRIM)} and coalesce({_get(_TRIM, 'csrd_category')}, '?') in ({Q}) and coalesce(trim({_get(_TRIM, 'chain_of_thought')}), '') <> ''"


@query("training_data", f"""with p as (select pair_id, regexp_replace(pair_id, '__dup[0-9]+$', '') as base, epoch, pair_type, prompt from pairs where {_OK} and (paragraph_id is null or paragraph_id not in {_HELD})),
    b as (select distinct base, epoch, pair_type from p),
    r as (select *, row_number() over (partition by epoch, pair_type order by {drawn('base')}, base) as k, count(*) over (partition by epoch, pair_type) as n from b),
    s as (select base, epoch, pair_type, case when k <= least(n - 1, greatest(1, cast(round(n * 0.12) as bigint))) then 'val' else 'train' end as part from r)
    select p.pair_id, s.part, concat('<s>[INST] ', 'Classe le paragraphe.', chr(10), chr(10), p.prompt, ' [/INST]') as prompt from p join s on p.base = s.base and p.epoch is not distinct from s.epoch and p.pair_type is not distinct from s.pair_type""")
def training_data(spark, d):
    """Valid pairs without held-out paragraphs, copies on one side of the split, prompts wrapped."""
    held = bind(spark, d, "corpus").join(bind(spark, d, "splits").where("lower(trim(split)) = 'test'"), "row_id", "left_semi")
    ok = jsonx.validity(F.regexp_replace("chosen", r"^[ \n]+|[ \n]+$", "")) == "ok"
    p = joins.without(bind(spark, d, "pairs").where(ok), held, "paragraph_id").withColumn("base", joins.base_id(F.col("pair_id")))
    parts = ranking.split(p.select("base", "epoch", "pair_type").distinct(), ["epoch", "pair_type"], "base", 0.12, 42)
    same = (p["base"] == parts["base"]) & p["epoch"].eqNullSafe(parts["epoch"]) & p["pair_type"].eqNullSafe(parts["pair_type"])
    return p.join(parts, same).select("pair_id", "part", text.chat(F.lit("Classe le paragraphe."), F.col("prompt")).alias("prompt"))


@query("evaluation_report", OK + f""", c as (select model, {CELLS} from ok group by model), s as (select model, {SCORES} from c),
    n as (select model, count(*) as n_rows, cast(sum(case when pred_label is null then 1 else 0 end) as bigint) as n_malformed from ok group by model)
    select s.*, n_rows, n_malformed from s join n on s.model = n.model""")
def evaluation_report(spark, d):
    """One row per model: scores, rows and malformed predictions; models are few, so both sides of
    the join are tiny."""
    p = filters.without_errors(bind(spark, d, "predictions"))
    s = metrics.scores(metrics.relevance(p, ["model"])).drop("tp", "fp", "fn", "tn")
    n = p.groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if(F.col("pred_label").isNull()).alias("n_malformed"))
    return s.join(n, "model")


@query("annotation_pool", cte("pool") + f", ok as (select p.row_id, p.epoch, p.doc_group, coalesce(year(c.date_envoi), 0) as y from pool p join corpus c on p.row_id = c.row_id) select row_id, epoch, doc_group, cast(y as bigint) as y, {BUCKET} as bucket from ok")
def annotation_pool(spark, d):
    """Paragraphs of the pool with the year and bucket of their filing."""
    c = bind(spark, d, "corpus").select("row_id", dates.year_of(F.col("date_envoi")).alias("y"))
    return bind(spark, d, "pool").select("row_id", "epoch", "doc_group").join(c, "row_id").withColumn("bucket", dates.year_bucket(F.col("y")))


@query("stratified_pool", STRATA + f""", k as (select s.row_id, s.stratum, s.density, c.document_id, row_number() over (partition by c.document_id order by s.density desc, s.row_id) as i from strata s join corpus c on s.row_id = c.row_id),
    kept as (select * from k where i <= 6), z as (select stratum, count(*) as size from kept group by stratum),
    q as (select stratum, size, least(size, greatest(5, cast(floor(2000 * size / cast(sum(size) over () as double)) as bigint))) as quota from z),
    o as (select *, sum(quota) over () - 2000 as excess, sum(case when quota > 5 then quota end) over () as above from q),
    f as (select stratum, case when excess > 0 and quota > 5 then greatest(5, quota - cast(floor(excess * quota / cast(above as double)) as bigint)) else quota end as quota from o),
    d as (select kept.row_id, kept.stratum, density, document_id, quota, row_number() over (partition by kept.stratum order by {drawn('kept.row_id')}, kept.row_id) as place from kept join f on kept.stratum = f.stratum)
    select row_id, document_id, stratum, density from d where place <= quota""")
def stratified_pool(spark, d):
    """2,000 paragraphs of the corpus by quality, strata, six a document, and quotas."""
    return strata.pool(bind(spark, d, "corpus"), 2000).select("row_id", "document_id", "stratum", "density")


_WEIGHTED = "(" + " union all ".join(f"select '{e}' as epoch, {max(1, int(800 * w + 1e-6))} as quota" for e, w in quotas.CANDIDATE_WEIGHTS.items()) + ")"
_PICKED = cte("candidates") + f""", x as (select c.* from candidates c where c.row_id not in (select row_id from gold where row_id is not null) and length(content) between 120 and 700),
    n as (select x.*, row_number() over (partition by x.epoch order by {drawn('x.row_id')}, x.row_id) as place, quota from x join {_WEIGHTED} w on x.epoch = w.epoch), picked as (select * from n where place <= quota)"""


@query("pair_construction", _PICKED + f""", t as (select *, case when silver = base then null when silver <> 'none' and base = 'none' then 'A_recency_fn' when silver = 'none' and base <> 'none' then 'B_overprediction_fp' else 'C_category_confusion' end as pair_type from picked),
    o as (select *, row_number() over (order by row_id) as k, coalesce(sum(case when pair_type is null then 0 else 1 end) over (order by row_id rows between unbounded preceding and 1 preceding), 0) as before from t),
    b as (select * from o where before < 200 and 2 * (k - 1) < 1000 and pair_type is not null),
    c as (select pair_type, count(*) as n from b group by pair_type), m as (select pair_type, n, greatest(1, cast(floor(greatest(min(n) over (), 100) * 3.0) as bigint)) as cap, sum(case when pair_type <> 'A_recency_fn' then n else 0 end) over () as g from c),
    k as (select pair_type, case when pair_type = 'A_recency_fn' and g > 0 then least(cap, greatest(1, cast(floor(g * 5.0) as bigint))) else cap end as cap from m),
    r as (select b.*, row_number() over (partition by b.pair_type order by {drawn('b.row_id')}, b.row_id) as i, cap from b join k on b.pair_type = k.pair_type)
    select concat('orpo_', lpad(cast(row_number() over (order by row_id) - 1 as varchar), 5, '0')) as pair_id, row_id, epoch, pair_type, silver as chosen_category, base as rejected_category, concat('Extrait : «', content, '»') as prompt from r where i <= cap""")
def pair_construction(spark, d):
    """Preference pairs of two models' labels: candidates outside the held-out rows drawn by the weights
    of the periods, both models asked within a budget of calls, disagreements typed, types balanced,
    pairs numbered."""
    c = joins.without(bind(spark, d, "candidates"), bind(spark, d, "gold"), "row_id").where(F.length("content").between(120, 700))
    picked = ranking.draw(c, "epoch", quotas.weighted(spark, quotas.CANDIDATE_WEIGHTS, 800), "row_id", 42)
    asked = models.both(picked, models.Labelled("silver"), models.Labelled("base")).withColumn("pair_type", pairs.pair_type(F.col("silver_category"), F.col("base_category")))
    made = pairs.within_budget(asked.withColumn("is_pair", F.col("pair_type").isNotNull()), ["row_id"], 200, 1000).where("is_pair")
    out = pairs.numbered(pairs.balance(cut(made), "row_id"), ["row_id"])
    return out.select("pair_id", "row_id", "epoch", "pair_type", F.col("silver_category").alias("chosen_category"), F.col("base_category").alias("rejected_category"), F.concat(F.lit("Extrait : «"), "content", F.lit("»")).alias("prompt"))


_TRIES = "least(length(content) % 5, 3) + case when length(content) % 5 < 3 then 1 else 0 end"


@query("annotated_rows", f"select row_id, cast({_TRIES} as int) as tries, case when length(content) % 5 >= 3 then 'score invalide' else '' end as errors, concat('score ', cast(case when length(content) % 5 >= 3 then 9 else 3 end as varchar)) as answer from corpus where content is not null")
def annotated_rows(spark, d):
    """Annotation with corrections by a stand-in that needs as many of them as the length of a text
    says; answers that two corrections do not mend stay with their errors."""
    got = models.annotate(bind(spark, d, "corpus").where("content is not null"), models.Stubborn(), models.Stubborn.validate, "row_id", "content")
    return got.select("row_id", "tries", F.concat_ws(";", "errors").alias("errors"), "answer")
