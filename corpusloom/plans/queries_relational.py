"""Queries on filters, joins, set operations, ranking and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import filters, joins, pairs, quotas, ranking
from ..operators.taxonomy import CATEGORIES, pillar
from .bindings import bind, cte
from .queries_text import LENIENT, bare
from .registry import query

TRUE = "lower(trim(member)) in ('1', 'true', 'oui', 'yes', 'vrai', 'x')"
FR = "lower(trim(lang)) in ('fr', 'français', 'french')"
DAY = f"cast({LENIENT} as date)"
IN_RANGE = f"{DAY} between date '2010-01-01' and date '2026-12-31'"


@query("truthy_filter", cte("metadata") + f" select row_id from metadata where {TRUE}")
def truthy_filter(spark, d):
    return bind(spark, d, "metadata").where(filters.truthy(F.col("member"))).select("row_id")


@query("language_fallback", cte("metadata") + f" select row_id from metadata where {FR} or not (select coalesce(bool_or({FR}), false) from metadata)")
def language_fallback(spark, d):
    return filters.where_or_all(bind(spark, d, "metadata"), filters.member(F.col("lang"), filters.FRENCH)).select("row_id")


@query("language_fallback_none", cte("metadata") + " select row_id from metadata")
def language_fallback_none(spark, d):
    return filters.where_or_all(bind(spark, d, "metadata"), filters.member(F.col("lang"), ["zz"])).select("row_id")


@query("date_range", cte("metadata") + f" select row_id from metadata where {IN_RANGE}")
def date_range(spark, d):
    return bind(spark, d, "metadata").where(filters.in_dates(dates.lenient_date(F.col("published")))).select("row_id")


@query("nonblank_url", cte("metadata") + " select row_id from metadata where trim(url) <> ''")
def nonblank_url(spark, d):
    return bind(spark, d, "metadata").where(F.trim("url") != "").select("row_id")


_FUNNEL = [("issuer", TRUE), ("language", FR), ("date", IN_RANGE), ("url", "trim(url) <> ''")]


@query("filter_funnel", cte("metadata") + " select 0 as step, 'all' as name, count(*) as n from metadata" + "".join(f" union all select {i + 1}, '{name}', count(*) from metadata where " + " and ".join(x for _, x in _FUNNEL[: i + 1]) for i, (name, _) in enumerate(_FUNNEL)))
def filter_funnel(spark, d):
    m = bind(spark, d, "metadata")
    steps = {"issuer": filters.truthy(F.col("member")), "language": filters.member(F.col("lang"), filters.FRENCH), "date": filters.in_dates(dates.lenient_date(F.col("published"))), "url": F.trim("url") != ""}
    return filters.funnel(m, steps)


@query("coercions", cte("annotations") + """ select row_id, who, case lower(trim(financial)) when 'oui' then true when 'true' then true when '1' then true when 'vrai' then true when 'non' then false when 'false' then false when '0' then false when 'faux' then false end as flag,
    nullif(trim(financial), '') as label, cast(trunc(try_cast(case when trim(financial) = '1' then '2.0' else financial end as double)) as bigint) as number from annotations""")
def coercions(spark, d):
    a = bind(spark, d, "annotations")
    n = F.when(F.trim("financial") == "1", "2.0").otherwise(F.col("financial"))
    return a.select("row_id", "who", filters.to_bool(F.col("financial")).alias("flag"), filters.to_label(F.col("financial")).alias("label"), filters.to_int(n).alias("number"))


@query("epoch_membership", "select row_id from corpus where trim(epoch) in ('2010-2014', '2015-2019', '2020-2022', '2023-2026')")
def epoch_membership(spark, d):
    return bind(spark, d, "corpus").where(filters.known_epoch(F.trim("epoch"))).select("row_id")


@query("length_between", "select row_id from corpus where length(content) between 120 and 700")
def length_between(spark, d):
    return bind(spark, d, "corpus").where(F.length("content").between(120, 700)).select("row_id")


@query("gold_loader", "select row_id, epoch from gold where epoch in ('2010-2014', '2015-2019', '2020-2022', '2023-2026') and length(content) > 10")
def gold_loader(spark, d):
    return bind(spark, d, "gold").where(filters.known_epoch(F.col("epoch")) & (F.length("content") > 10)).select("row_id", "epoch")


@query("complete_records", "select pair_id from pairs where prompt is not null and chosen is not null and rejected is not null and pair_type is not null")
def complete_records(spark, d):
    return filters.complete(bind(spark, d, "pairs"), ["prompt", "chosen", "rejected", "pair_type"]).select("pair_id")


@query("error_rows", cte("predictions") + " select row_id, model from predictions where coalesce(trim(error), '') = ''")
def error_rows(spark, d):
    return filters.without_errors(bind(spark, d, "predictions")).select("row_id", "model")


@query("fewshot_exclusion", f"select row_id from corpus where content is null or substring({bare('content')}, 1, 80) not in (select substring({bare('content')}, 1, 80) from corpus where row_id % 500 = 0 and content is not null)")
def fewshot_exclusion(spark, d):
    c = bind(spark, d, "corpus")
    return joins.without_signatures(c, c.where("row_id % 500 = 0"), 80).select("row_id")


@query("binary_flags", cte("predictions") + " select row_id, model, cast(gold_label is distinct from 'none' as bigint) as gold_flag, cast(pred_label is distinct from 'none' as bigint) as pred_flag from predictions")
def binary_flags(spark, d):
    p = bind(spark, d, "predictions")
    return p.select("row_id", "model", filters.relevant(F.col("gold_label")).alias("gold_flag"), filters.relevant(F.col("pred_label")).alias("pred_flag"))


@query("schema_normalise", "select row_id, document_id as article_id, date_envoi as publish_date, type_document as doc_type, emetteur as author, content, cast(null as varchar) as csrd_category from corpus")
def schema_normalise(spark, d):
    from ..schemas import PUBLIC_TO_INTERNAL, normalise

    return normalise(bind(spark, d, "corpus"), {**{v: [v, k] for k, v in PUBLIC_TO_INTERNAL.items()}, "row_id": ["row_id"], "content": ["content"], "csrd_category": ["csrd_category"]})


@query("nonempty_content", "select row_id from corpus where length(trim(content)) > 0")
def nonempty_content(spark, d):
    return bind(spark, d, "corpus").where(F.length(F.trim("content")) > 0).select("row_id")


# joins and set membership
_HM = cte("annotations") + ", h as (select * from annotations where who = 'human'), m as (select * from annotations where who = 'model')"


def _sides(spark, d):
    a = bind(spark, d, "annotations")
    return a.where("who = 'human'"), a.where("who = 'model'")


@query("inner_pairs", _HM + " select h.row_id, h.csrd_category as csrd_category_human, m.csrd_category as csrd_category_model, cast(h.score as bigint) as score_human, cast(m.score as bigint) as score_model from h join m on h.row_id = m.row_id")
def inner_pairs(spark, d):
    j = joins.paired(*_sides(spark, d), "row_id", ("human", "model"))
    return j.select("row_id", "csrd_category_human", "csrd_category_model", F.col("score_human").cast("long").alias("score_human"), F.col("score_model").cast("long").alias("score_model"))


@query("missing_either_side", _HM + " select row_id, 'model' as missing from h where row_id not in (select row_id from m) union all select row_id, 'human' from m where row_id not in (select row_id from h)")
def missing_either_side(spark, d):
    return joins.missing(*_sides(spark, d), "row_id", ("human", "model"))


@query("gold_exclusion", f"""select row_id from corpus c where (paragraph_id is null or paragraph_id not in (select paragraph_id from gold where paragraph_id is not null))
    and (content is null or substring({bare('content')}, 1, 100) not in (select substring({bare('content')}, 1, 100) from gold where content is not null))""")
def gold_exclusion(spark, d):
    g = bind(spark, d, "gold")
    return joins.without_signatures(joins.without(bind(spark, d, "corpus"), g, "paragraph_id"), g, 100).select("row_id")


@query("publish_anti", "select row_id from corpus where paragraph_id is null or paragraph_id not in (select paragraph_id from gold where paragraph_id is not null)")
def publish_anti(spark, d):
    return joins.without(bind(spark, d, "corpus"), bind(spark, d, "gold"), "paragraph_id").select("row_id")


@query("semi_anti_passes", "select row_id, case when row_id in (select row_id from splits where lower(trim(split)) = 'test') then 'iaa' else 'mass' end as pass from corpus where row_id not in (select row_id from splits where lower(trim(split)) = 'validation')")
def semi_anti_passes(spark, d):
    s = bind(spark, d, "splits").withColumn("split", F.lower(F.trim("split")))
    return joins.passes(bind(spark, d, "corpus"), s.where("split = 'test'"), s.where("split = 'validation'"), "row_id").select("row_id", "pass")


@query("resume_remaining", cte("ledger") + " select row_id from corpus where row_id not in (select row_id from ledger where status is not null)")
def resume_remaining(spark, d):
    return joins.without(bind(spark, d, "corpus"), bind(spark, d, "ledger").where("status is not null"), "row_id").select("row_id")


@query("leakage_check", "select regexp_replace(p.pair_id, '__dup[0-9]+$', '') as base_id, count(*) as n from pairs p where paragraph_id in (select c.paragraph_id from corpus c join splits s on c.row_id = s.row_id where lower(trim(s.split)) = 'test') group by 1")
def leakage_check(spark, d):
    held = bind(spark, d, "corpus").join(bind(spark, d, "splits").where("lower(trim(split)) = 'test'"), "row_id")
    return joins.leaked(bind(spark, d, "pairs"), held, "paragraph_id").groupBy("base_id").agg(F.count("*").alias("n"))


@query("model_alignment", cte("predictions") + ", ok as (select * from predictions where coalesce(trim(error), '') = '') select row_id from ok group by row_id having count(distinct model) = (select count(distinct model) from ok)")
def model_alignment(spark, d):
    return joins.seen_by_all(filters.without_errors(bind(spark, d, "predictions")), "row_id", "model").select("row_id")


@query("prefix_lookup", f"""with k as (select substring({bare('content')}, 1, 80) as sig, row_id, row_number() over (partition by substring({bare('content')}, 1, 80) order by row_id) as r from corpus where content is not null)
    select g.row_id as gold_row, k.row_id as corpus_row from gold g left join k on substring({bare('g.content')}, 1, 80) = k.sig and k.r = 1""")
def prefix_lookup(spark, d):
    got = joins.prefix_lookup(bind(spark, d, "gold"), bind(spark, d, "corpus"), "row_id", 80)
    return got.select(F.col("row_id").alias("gold_row"), F.col("found").alias("corpus_row"))


@query("pillar_lookup", "select pair_id, chosen_category, case " + " ".join(f"when chosen_category = '{c}' then '{p}'" for c, p, _ in CATEGORIES) + " else 'unknown' end as pillar from pairs")
def pillar_lookup(spark, d):
    return bind(spark, d, "pairs").select("pair_id", "chosen_category", pillar(F.col("chosen_category")).alias("pillar"))


@query("iaa_flag", "select row_id, row_id in (select row_id from splits where lower(trim(split)) = 'test') as iaa_subset from corpus")
def iaa_flag(spark, d):
    return joins.flag(bind(spark, d, "corpus"), bind(spark, d, "splits").where("lower(trim(split)) = 'test'"), "row_id", "iaa_subset").select("row_id", "iaa_subset")


@query("union_predictions", cte("predictions") + " select model, count(*) as n from predictions group by model")
def union_predictions(spark, d):
    """The tables of all models as one."""
    p = bind(spark, d, "predictions")
    parts = [p.where(F.col("model") == m).drop("model").withColumn("model", F.lit(m)) for m in ("m1", "m2", "m3")]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("model").agg(F.count("*").alias("n"))


@query("id_set_operations", "select 'both' as op, count(*) as n from (select paragraph_id from corpus intersect select paragraph_id from pairs) union all select 'only_corpus', count(*) from (select paragraph_id from corpus except select paragraph_id from pairs)")
def id_set_operations(spark, d):
    a, b = bind(spark, d, "corpus").select("paragraph_id"), bind(spark, d, "pairs").select("paragraph_id")
    count = lambda x, op: x.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only_corpus"))


# ranking and sampling; every draw is in the order of md5(id:seed), so SQL can repeat it
def drawn(c: str) -> str:
    return f"md5(concat_ws(':', cast({c} as varchar), '42'))"


@query("topk_per_doc", cte("pool") + " select row_id, document_id, cast(r as bigint) as r from (select *, row_number() over (partition by document_id order by score desc, paragraph_id, row_id) as r from pool where document_id is not null) p where r <= 6")
def topk_per_doc(spark, d):
    got = ranking.top_k(bind(spark, d, "pool").where("document_id is not null"), ["document_id"], [F.desc("score"), "paragraph_id", "row_id"], 6, "r")
    return got.select("row_id", "document_id", F.col("r").cast("long").alias("r"))


_QUOTA = """, sizes as (select doc_group as stratum, count(*) as size from pool group by doc_group), q as (select stratum, size, least(size, greatest(5, cast(floor(500 * size / cast(sum(size) over () as double)) as bigint))) as quota from sizes)"""


@query("quota_proportional", cte("pool") + _QUOTA + " select stratum, size, cast(quota as bigint) as quota from q")
def quota_proportional(spark, d):
    return quotas.proportional(bind(spark, d, "pool").groupBy(F.col("doc_group").alias("stratum")).agg(F.count("*").alias("size")), 500, 5)


@query("stratified_draw", cte("pool") + _QUOTA + f" select row_id, doc_group from (select p.row_id, p.doc_group, row_number() over (partition by p.doc_group order by {drawn('p.row_id')}, p.row_id) as r, quota from pool p join q on p.doc_group = q.stratum) z where r <= quota")
def stratified_draw(spark, d):
    pool = bind(spark, d, "pool")
    q = quotas.proportional(pool.groupBy(F.col("doc_group").alias("stratum")).agg(F.count("*").alias("size")), 500, 5)
    return ranking.draw(pool, "doc_group", q.select(F.col("stratum").alias("doc_group"), "quota"), "row_id", 42).select("row_id", "doc_group")


def exact_sql(sizes: str, total: int, floor: int, out: str) -> str:
    """Common table expressions that end in ``out`` (stratum, size, quota): quotas of the sizes that
    sum to the total, evened out in turns, the largest room first."""
    return f"""{out}a as (select stratum, size, least(greatest({floor}, cast(round_even({total} * size / cast(sum(size) over () as double), 0) as bigint)), size) as q from {sizes}),
        {out}b as (select *, sum(q) over () - {total} as over_ from {out}a), {out}c as (select *, case when over_ > 0 then greatest(0, q - {floor}) else size - q end as room from {out}b),
        {out}d as (select *, least(abs(over_), sum(room) over ()) as amount from {out}c),
        {out}l as (select max(l) as lo from (select l, (select sum(least(room, l)) from {out}d) as taken, (select max(amount) from {out}d) as amount from range(0, (select cast(max(room) + 1 as bigint) from {out}d)) r(l)) x where taken <= amount),
        {out}e as (select *, amount - sum(least(room, lo)) over () as rest, row_number() over (order by case when room > lo then 0 else 1 end, room desc, stratum) as place from {out}d cross join {out}l),
        {out} as (select stratum, size, cast(q + case when over_ > 0 then -1 else 1 end * (least(room, lo) + case when room > lo and place <= rest then 1 else 0 end) as bigint) as quota from {out}e)"""


@query("quota_exact", cte("pool") + ", z as (select doc_group as stratum, count(*) as size from pool group by doc_group), " + exact_sql("z", 400, 5, "q") + " select stratum, size, quota from q")
def quota_exact(spark, d):
    sizes = bind(spark, d, "pool").groupBy(F.col("doc_group").alias("stratum")).agg(F.count("*").alias("size"))
    return quotas.exact(sizes, 400, 5)


@query("round_robin", cte("pool") + f""", a as (select row_id, epoch, doc_group, row_number() over (partition by epoch, doc_group order by {drawn('row_id')}, row_id) as r from pool where epoch is not null),
    b as (select *, row_number() over (partition by epoch order by r, {drawn('doc_group')}, doc_group) as k from a) select row_id, epoch, doc_group from b where k <= 40""")
def round_robin(spark, d):
    return ranking.round_robin(bind(spark, d, "pool").where("epoch is not null"), "epoch", "doc_group", "row_id", 40, 42).select("row_id", "epoch", "doc_group")


@query("train_val_split", f"""with p as (select distinct regexp_replace(pair_id, '__dup[0-9]+$', '') as base, epoch, pair_type from pairs),
    r as (select *, row_number() over (partition by epoch, pair_type order by {drawn('base')}, base) as k, count(*) over (partition by epoch, pair_type) as n from p)
    select base, epoch, pair_type, case when k <= least(n - 1, greatest(1, cast(round(n * 0.12) as bigint))) then 'val' else 'train' end as part from r""")
def train_val_split(spark, d):
    base = bind(spark, d, "pairs").select(joins.base_id(F.col("pair_id")).alias("base"), "epoch", "pair_type").distinct()
    return ranking.split(base, ["epoch", "pair_type"], "base", 0.12, 42)


@query("weighted_candidates", cte("pool") + f""", w as (select '2010-2014' as epoch, 0.4 as w union all select '2015-2019', 0.3 union all select '2020-2022', 0.2 union all select '2023-2026', 0.1),
    r as (select p.row_id, p.epoch, row_number() over (partition by p.epoch order by {drawn('p.row_id')}, p.row_id) as k, greatest(1, cast(floor(300 * cast(w as double) + 0.000001) as bigint)) as q from pool p join w on p.epoch = w.epoch)
    select row_id, epoch from r where k <= q""")
def weighted_candidates(spark, d):
    q = quotas.weighted(spark, quotas.CANDIDATE_WEIGHTS, 300)
    return ranking.draw(bind(spark, d, "pool"), "epoch", q, "row_id", 42).select("row_id", "epoch")


@query("fewshot_pick", "select row_id, csrd_category from (select row_id, csrd_category, row_number() over (partition by csrd_category order by row_id) as r from gold where csrd_category is not null) g where r = 1 order by csrd_category limit 5")
def fewshot_pick(spark, d):
    """One held-out row of each of the first categories."""
    return ranking.one_of_each(bind(spark, d, "gold"), "csrd_category", ["row_id"], 5).select("row_id", "csrd_category")


@query("dedup_first", "select paragraph_id, min(row_id) as row_id from corpus where content is not null group by paragraph_id")
def dedup_first(spark, d):
    return ranking.first_of(bind(spark, d, "corpus").where("content is not null"), ["paragraph_id"], ["row_id"]).select("paragraph_id", "row_id")


@query("url_dedup", cte("metadata", "ledger") + ", u as (select trim(url) as url, min(row_id) as row_id from metadata where trim(url) <> '' group by trim(url)) select u.url, u.row_id from u where u.url not in (select trim(m.url) from metadata m join ledger l on m.row_id = l.row_id where l.status is not null and m.url is not null)")
def url_dedup(spark, d):
    m, ledger = bind(spark, d, "metadata").withColumn("url", F.trim("url")), bind(spark, d, "ledger")
    seen = m.join(ledger.where("status is not null").select("row_id"), "row_id", "left_semi")
    return joins.without(ranking.first_of(m.where("url <> ''"), ["url"], ["row_id"]), seen, "url").select("url", "row_id")


@query("dense_row_id", "select row_id, cast(row_number() over (order by paragraph_id nulls first, row_id) - 1 as bigint) as dense_id from corpus")
def dense_row_id(spark, d):
    return ranking.dense_id(bind(spark, d, "corpus").select("row_id", "paragraph_id"), ["paragraph_id", "row_id"], "dense_id").select("row_id", "dense_id")


@query("example_picker", """with t as (select row_id, 1 as p from gold where csrd_category is not null and csrd_category <> 'none' and length(content) between 120 and 2000 union all select row_id, 2 from gold where csrd_category = 'none' union all select row_id, 3 from gold),
    a as (select row_id, p, row_number() over (partition by p order by row_id) as r from t), b as (select row_id, min(p) as p from a where r <= 4 group by row_id)
    select row_id, cast(p as bigint) as priority from b order by p, row_id limit 8""")
def example_picker(spark, d):
    g = bind(spark, d, "gold")
    subsets = [g.where("csrd_category <> 'none' and length(content) between 120 and 2000"), g.where("csrd_category = 'none'"), g]
    return ranking.pick_by_priority(subsets, "row_id", 4, 8)


@query("seeded_shuffle", f"select row_id, cast(row_number() over (order by {drawn('row_id')}, row_id) as bigint) as place from corpus")
def seeded_shuffle(spark, d):
    return ranking.shuffle(bind(spark, d, "corpus").select("row_id"), "row_id", 42, "place")


@query("head_limit", "select row_id, epoch from gold order by row_id limit 25")
def head_limit(spark, d):
    return bind(spark, d, "gold").orderBy("row_id").limit(25).select("row_id", "epoch")


@query("publish_clean", f"""select cast(row_number() over (order by paragraph_id, source_row) - 1 as bigint) as row_id, source_row, paragraph_id from (select row_id as source_row, paragraph_id, row_number() over (partition by paragraph_id order by row_id) as r from corpus
    where length(trim(content)) > 0 and paragraph_id not in (select paragraph_id from gold where paragraph_id is not null)) c where r = 1""")
def publish_clean(spark, d):
    from ..operators.publish import clean

    return clean(bind(spark, d, "corpus"), bind(spark, d, "gold"), dedupe=True).select("row_id", "source_row", "paragraph_id")




@query("half_even_rounding", "select row_id, round_even(row_id / 8.0, 2) as two, round_even(row_id / 16.0, 1) as one from corpus")
def half_even_rounding(spark, d):
    """Rounding to the even neighbour where two are as near."""
    return bind(spark, d, "corpus").select("row_id", F.bround(F.col("row_id") / 8, 2).alias("two"), F.bround(F.col("row_id") / 16, 1).alias("one"))


_SHOTS = "select 1 as i, 'Texte de référence sans enjeu.' as content, 'none' as label union all select 2, 'La trajectoire carbone est publiée.', 'E1' union all select 3, 'La formation des salariés progresse.', 'S1'"


@query("fewshot_prompt", f"""with g as (select row_id, csrd_category, content, row_number() over (partition by csrd_category order by row_id) as r from gold where csrd_category is not null and csrd_category like 'E%'),
    own as (select 0 as source, row_number() over (order by csrd_category) as i, content, csrd_category as label from g where r = 1 order by i limit 8),
    x as (select * from own union all select 1, i, content, label from ({_SHOTS}) d), n as (select *, row_number() over (order by source, i) as k from x)
    select string_agg('Exemple ' || k || ' :' || chr(10) || 'Extrait : «' || coalesce(content, '') || '»' || chr(10) || 'Réponse : ' || label, chr(10) || chr(10) order by k) as prompt, count(*) as n from n where k <= 8""")
def fewshot_prompt(spark, d):
    """Examples of eight categories from the held-out rows, made up from defaults where there are fewer."""
    own = ranking.one_of_each(bind(spark, d, "gold").where("csrd_category like 'E%'"), "csrd_category", ["row_id"], 8).select("content", F.col("csrd_category").alias("label"))
    shots = ranking.padded(own, ["label"], spark.sql(_SHOTS), ["i"], 8)
    return text.n_shot(shots, "place", "content", "label")


@query("pair_diagnosis", cte("candidates") + " select cast(sum(case when silver <> base then 1 else 0 end) as bigint) as n_pair, cast(sum(case when silver = base then 1 else 0 end) as bigint) as n_agreement, cast(sum(case when silver = 'none' and base = 'none' then 1 else 0 end) as bigint) as n_both_none, cast(sum(case when silver is null or base is null then 1 else 0 end) as bigint) as n_error from candidates")
def pair_diagnosis(spark, d):
    """What two models' labels come to: pairs, agreements, those on none, and failed calls."""
    return pairs.diagnosis(bind(spark, d, "candidates"), F.col("silver"), F.col("base"))
