"""Queries on JSON answers, annotation rules, preference pairs, ingestion state and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import joins, metrics, pairs, probe, publish, ranking, taxonomy
from ..operators.models import HashedEncoder, KeywordStub, classify, hidden_states
from ..operators.taxonomy import CODES, HORIZONS, SUBCODES, SURPRISE
from .bindings import bind, cte
from .queries_metrics import CELLS, SCORES
from .queries_text import INGESTED
from .registry import query

Q = "'" + "', '".join(CODES) + "'"
X = r"nullif(regexp_extract(chosen, '(?s)\{.*\}', 0), '')"


@query("json_extract", f"select pair_id, {X} as body from pairs")
def json_extract(spark, d):
    return bind(spark, d, "pairs").select("pair_id", jsonx.outermost(F.col("chosen")).alias("body"))


def _valid(x: str) -> str:
    """Strictly valid: DuckDB's parser lets a comma before a close pass."""
    return f"(json_valid({x}) and not regexp_matches({x}, ',\\s*[}}\\]]'))"


def _get(x: str, key: str) -> str:
    return f"case when {_valid(x)} then json_extract_string({x}, '$.{key}') end"


@query("json_tolerant", f"""with p as (select pair_id, {X} as x from pairs), c as (select pair_id, x, case when {_get('x', 'csrd_category')} in ({Q}) then {_get('x', 'csrd_category')} else 'none' end as category from p)
    select pair_id, category, case when category = 'none' then '' else coalesce({_get('x', 'esrs_subcategory')}, '') end as subcategory, coalesce({_get('x', 'chain_of_thought')}, '') as rationale from c""")
def json_tolerant(spark, d):
    return bind(spark, d, "pairs").select("pair_id", jsonx.tolerant(F.col("chosen")).alias("t")).select("pair_id", "t.*")


REPAIR = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '''', '\"'), '\bNone\b', 'null', 'g'), '\bTrue\b', 'true', 'g'), '\bFalse\b', 'false', 'g'), ',\s*([}\]])', '\1', 'g')".replace('\\"', '"')


@query("json_repair", f"with p as (select pair_id, {X} as x from pairs), r as (select pair_id, x, {REPAIR} as y from p), c as (select pair_id, coalesce({_get('x', 'csrd_category')}, {_get('y', 'csrd_category')}) as c from r) select pair_id, case when c in ({Q}) then c end as category from c")
def json_repair(spark, d):
    return bind(spark, d, "pairs").select("pair_id", jsonx.repaired_category(F.col("chosen")).alias("category"))


@query("json_canonical", "select pair_id, concat('{\"csrd_category\":\"', chosen_category, '\",\"esrs_subcategory\":\"', pair_type, '\",\"chain_of_thought\":', coalesce('\"' || epoch || '\"', 'null'), '}') as body from pairs")
def json_canonical(spark, d):
    return bind(spark, d, "pairs").select("pair_id", jsonx.canonical(F.col("chosen_category"), F.col("pair_type"), F.col("epoch")).alias("body"))


@query("pair_validity", f"select pair_id, case when chosen is null or not {_valid('chosen')} or chosen not like '{{%' then 'unparsable' when coalesce({_get('chosen', 'csrd_category')}, '?') not in ({Q}) then 'category' when coalesce(trim({_get('chosen', 'chain_of_thought')}), '') = '' then 'rationale' else 'ok' end as verdict from (select pair_id, trim(chosen, ' ' || chr(10)) as chosen from pairs) p")
def pair_validity(spark, d):
    return bind(spark, d, "pairs").select("pair_id", jsonx.validity(F.regexp_replace("chosen", r"^[ \n]+|[ \n]+$", "")).alias("verdict"))


@query("corrupt_lines", "with l as (select pair_id, case when length(pair_id) % 2 = 0 and pair_id like '%5' then '{\"pair_id\": \"' || pair_id else '{\"pair_id\": \"' || pair_id || '\"}' end as line from pairs) select cast(sum(case when json_valid(line) then 0 else 1 end) as bigint) as n_bad, cast(sum(case when json_valid(line) then 1 else 0 end) as bigint) as n_good from l")
def corrupt_lines(spark, d):
    cut = (F.length("pair_id") % 2 == 0) & F.col("pair_id").endswith("5")
    line = F.when(cut, F.concat(F.lit('{"pair_id": "'), "pair_id")).otherwise(F.concat(F.lit('{"pair_id": "'), "pair_id", F.lit('"}')))
    bad = F.from_json(line, "pair_id string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNotNull()
    return bind(spark, d, "pairs").select(bad.alias("bad")).agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"))


@query("nested_codec", "select row_id, concat('[\"', epoch, '\",\"', cast(row_id % 5 as varchar), '\"]') as encoded, epoch as first_item, cast(2 as bigint) as n from corpus where epoch is not null")
def nested_codec(spark, d):
    c = bind(spark, d, "corpus").where("epoch is not null").select("row_id", F.to_json(F.array("epoch", (F.col("row_id") % 5).cast("string"))).alias("encoded"))
    items = F.from_json("encoded", "array<string>")
    return c.select("row_id", "encoded", items[0].alias("first_item"), F.size(items).cast("long").alias("n"))


@query("final_answers", f"select pair_id, {_get('x', 'csrd_category')} as category from (select pair_id, {X} as x from pairs) p where {_valid('x')}")
def final_answers(spark, d):
    m = bind(spark, d, "pairs").select("pair_id", jsonx.to_map(jsonx.outermost(F.col("chosen"))).alias("m")).where("m is not null")
    return m.select("pair_id", F.try_element_at("m", F.lit("csrd_category")).alias("category"))


def _errors_sql() -> str:
    none = "csrd_category = 'none'"
    subs = " or ".join(f"(csrd_category = '{c}' and esrs_subcategory in ('" + "', '".join(s) + "'))" for c, s in SUBCODES.items())
    rules = [
        ("coalesce(materialite_score not between 0 and 5, true)", "materialite_score invalide"),
        (f"materialite_score between 0 and 5 and {none} and materialite_score <> 0", "materialite_score doit être 0"),
        (f"materialite_score between 0 and 5 and not ({none}) and materialite_score = 0", "materialite_score incohérent"),
        (f"{none} and coalesce(esrs_subcategory, 'none') <> 'none'", "esrs_subcategory doit être null"),
        (f"not ({none}) and not coalesce(({subs}), false)", "esrs_subcategory invalide"),
        ("materialite_financiere is null", "materialite_financiere doit être un booléen"),
        (f"{none} and materialite_financiere", "materialite_financiere doit être False"),
        ("materialite_impact is null", "materialite_impact doit être un booléen"),
        (f"{none} and materialite_impact", "materialite_impact doit être False"),
        (f"coalesce(market_surprise not in ({str(SURPRISE)[1:-1]}), true)", "market_surprise invalide"),
        (f"{none} and horizon_temporel is not null", "horizon_temporel doit être null"),
        (f"not ({none}) and not coalesce(horizon_temporel in ({str(HORIZONS)[1:-1]}), false)", "horizon_temporel invalide"),
        ("coalesce(length(trim(chain_of_thought)) < 10, true)", "chain_of_thought trop court"),
        ("not (confiance_annotation between 0 and 1)", "confiance_annotation invalide"),
    ]
    parts = ", ".join(f"case when {a} then '{b}' end" for a, b in rules)
    return f"case when csrd_category in ({Q}) then concat_ws('; ', {parts}) else 'csrd_category invalide' end"


@query("annotation_errors", cte("objects") + f" select row_id, {_errors_sql()} as errors from objects")
def annotation_errors(spark, d):
    return taxonomy.annotation_errors(bind(spark, d, "objects")).select("row_id", F.concat_ws("; ", "errors").alias("errors"))


@query("annotation_report", cte("objects") + f", e as (select unnest(string_split(case when x = '' then 'valide' else x end, '; ')) as error from (select {_errors_sql()} as x from objects) z) select error, count(*) as n from e group by error")
def annotation_report(spark, d):
    return taxonomy.batch_report(taxonomy.annotation_errors(bind(spark, d, "objects")))


@query("first_invalid", cte("objects") + f", e as (select row_id, {_errors_sql()} as errors from objects) select row_id, errors from e where errors <> '' order by row_id limit 10")
def first_invalid(spark, d):
    """The first ten annotations that break a rule."""
    got = taxonomy.first_invalid(taxonomy.annotation_errors(bind(spark, d, "objects")), "row_id")
    return got.select("row_id", F.concat_ws("; ", "errors").alias("errors"))


# preference pairs
TYPE = "case when silver = base then null when silver <> 'none' and base = 'none' then 'A_recency_fn' when silver = 'none' and base <> 'none' then 'B_overprediction_fp' else 'C_category_confusion' end"
C = cte("candidates") + f", t as (select *, {TYPE} as pair_type from candidates)"


def _typed(spark, d):
    return bind(spark, d, "candidates").withColumn("pair_type", pairs.pair_type(F.col("silver"), F.col("base")))


@query("pair_typing", C + " select row_id, case when silver = base then 'agreement' else 'pair' end as status, pair_type from t")
def pair_typing(spark, d):
    return _typed(spark, d).select("row_id", pairs.status(F.col("silver"), F.col("base")).alias("status"), "pair_type")


@query("budget_stop", C + ", o as (select row_id, row_number() over (order by row_id) as k, coalesce(sum(case when pair_type is null then 0 else 1 end) over (order by row_id rows between unbounded preceding and 1 preceding), 0) as before from t) select row_id from o where before < 150 and 2 * (k - 1) < 700")
def budget_stop(spark, d):
    return pairs.within_budget(_typed(spark, d).withColumn("is_pair", F.col("pair_type").isNotNull()), ["row_id"], 150, 700).select("row_id")


_CAPS = ", c as (select pair_type, count(*) as n from t where pair_type is not null group by pair_type), b as (select pair_type, n, greatest(1, cast(floor(greatest(min(n) over (), 100) * 3.0) as bigint)) as cap, sum(case when pair_type <> 'A_recency_fn' then n else 0 end) over () as g from c), k as (select pair_type, n, case when pair_type = 'A_recency_fn' and g > 0 then least(cap, greatest(1, cast(floor(g * 5.0) as bigint))) else cap end as cap from b)"


@query("balance_caps", C + _CAPS + " select pair_type, n, cast(cap as bigint) as cap from k")
def balance_caps(spark, d):
    return pairs.caps(_typed(spark, d))


@query("balanced_pairs", C + _CAPS + ", r as (select t.row_id, t.pair_type, cap, row_number() over (partition by t.pair_type order by md5(concat_ws(':', cast(t.row_id as varchar), '42')), t.row_id) as i from t join k on t.pair_type = k.pair_type) select row_id, pair_type from r where i <= cap")
def balanced_pairs(spark, d):
    return pairs.balance(_typed(spark, d), "row_id").select("row_id", "pair_type")


@query("oversample_guardrail", "select pair_id, case when pair_type = 'A_recency_fn' then paragraph_id else paragraph_id || '__dup' || cast(i as varchar) end as paragraph_id from pairs cross join (select 0 as i union all select 1 union all select 2) c where pair_type is distinct from 'A_recency_fn' or i = 0")
def oversample_guardrail(spark, d):
    return pairs.oversample(bind(spark, d, "pairs"), 3).select("pair_id", "paragraph_id")


@query("epoch_type_matrix", C + " select epoch, " + ", ".join(f"cast(count(case when pair_type = '{t}' then 1 end) as bigint) as \"{t}\"" for t in pairs.TYPES) + " from t where epoch is not null group by epoch")
def epoch_type_matrix(spark, d):
    return _typed(spark, d).where("epoch is not null").groupBy("epoch").pivot("pair_type", pairs.TYPES).count().na.fill(0)


@query("label_share", "select coalesce(chosen_category, '?') as label, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from pairs group by 1")
def label_share(spark, d):
    return pairs.label_shares(bind(spark, d, "pairs"), "chosen_category")


@query("refuge_verdict", "select pair_type, cast(sum(case when chosen_category = 'ESRS2' then 1 else 0 end) as bigint) as n_refuge, count(*) as n, round(sum(case when chosen_category = 'ESRS2' then 1 else 0 end) / cast(count(*) as double), 6) as share, round(sum(case when chosen_category = 'ESRS2' then 1 else 0 end) / cast(count(*) as double), 6) > 0.2 as high from pairs group by pair_type")
def refuge_verdict(spark, d):
    return pairs.refuge_verdict(bind(spark, d, "pairs"), "chosen_category", ["pair_type"])


@query("truncation_signature", f"with v as (select pair_type, coalesce(length({_get('x', 'chain_of_thought')}), 0) as n from (select pair_type, {X} as x from pairs) p) select pair_type, count(*) as n_pairs, cast(sum(case when n < 10 then 1 else 0 end) as bigint) as n_short from v group by pair_type")
def truncation_signature(spark, d):
    n = F.length(jsonx.key_of(jsonx.to_map(jsonx.outermost(F.col("chosen"))), "chain_of_thought"))
    return bind(spark, d, "pairs").groupBy("pair_type").agg(F.count("*").alias("n_pairs"), F.count_if(F.coalesce(n, F.lit(0)) < 10).alias("n_short"))


@query("yield_estimate", cte("candidates") + ", y as (" + " union all ".join(f"select '{e}' as epoch, {w} as w" for e, w in pairs.YIELDS.items()) + ") select y.epoch, count(c.row_id) as n_candidates, cast(floor(count(c.row_id) * cast(max(w) as double) + 0.000000001) as bigint) as n_expected from y left join candidates c on y.epoch = c.epoch group by y.epoch")
def yield_estimate(spark, d):
    return pairs.expected_yield(spark, bind(spark, d, "candidates"))


@query("length_stats", "with w as (select pair_type, len(regexp_split_to_array(trim(prompt), '\\s+')) as n from pairs where trim(prompt) <> '') select pair_type, round(avg(n), 6) as mean_words, cast(max(n) as bigint) as max_words from w group by pair_type")
def length_stats(spark, d):
    n = F.size(F.split(F.trim("prompt"), r"\s+"))
    return bind(spark, d, "pairs").where("trim(prompt) <> ''").groupBy("pair_type").agg(F.round(F.avg(n), 6).alias("mean_words"), F.max(n).cast("long").alias("max_words"))


@query("pair_ids", C + " select row_id, concat('orpo_', lpad(cast(row_number() over (order by row_id) - 1 as varchar), 5, '0')) as pair_id from t where pair_type is not null")
def pair_ids(spark, d):
    return pairs.numbered(_typed(spark, d).where("pair_type is not null").select("row_id"), ["row_id"]).select("row_id", "pair_id")


# state
@query("retry_failed", cte("ledger") + " select row_id, case when status is null then 'new' else 'retry' end as why from ledger where status is null or status = 'failed'")
def retry_failed(spark, d):
    from ..streaming.ingest import remaining

    ids = bind(spark, d, "corpus").select("row_id")
    return remaining(ids, bind(spark, d, "ledger").where("status is not null"), "row_id", retry_failed=True).select("row_id", "why")


@query("coverage_stats", cte("ledger") + " select coalesce(status, 'pending') as status, coalesce(error_code, '') as error_code, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from ledger group by 1, 2")
def coverage_stats(spark, d):
    from ..streaming.ingest import coverage

    return coverage(bind(spark, d, "ledger"))


@query("ingest_micro_batches", INGESTED)
def ingest_micro_batches(spark, d):
    from ..streaming.ingest import ingest_paragraphs

    return ingest_paragraphs(spark, f"{d}/documents.parquet")


@query("event_windows", "select event_type, cast(cast(time_bucket(interval '1 hour', ts) as timestamp) as varchar) as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    from ..streaming.ingest import hourly

    e = hourly(bind(spark, d, "events"))
    return e.select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 4).alias("total"))


# probes on vectors
@query("probe_cv_accuracy")
def probe_cv_accuracy(spark, d):
    return probe.cross_validated(probe.layers(bind(spark, d, "embeddings"), 2))


@query("best_layer")
def best_layer(spark, d):
    return ranking.arg_max(probe.cross_validated(probe.layers(bind(spark, d, "embeddings"), 2)), "layer", "accuracy_mean")


@query("permutation_p")
def permutation_p(spark, d):
    return probe.permutation_test(bind(spark, d, "embeddings"))


def _stub_sql(c: str) -> str:
    return "case " + " ".join(f"when {' or '.join(f'contains(lower(coalesce({c}, {chr(39) * 2})), {chr(39)}{w}{chr(39)})' for w in ws)} then '{k}'" for k, ws in KeywordStub.WORDS.items()) + " else 'none' end"


@query("stub_predictions", f"select row_id, l as pred_label, case when l <> 'none' then l || '-1' end as pred_subcategory, 'Classement en ' || l || ' par mots-clés.' as pred_rationale, cast(null as varchar) as error from (select row_id, {_stub_sql('content')} as l from gold) x")
def stub_predictions(spark, d):
    return classify(bind(spark, d, "gold").select("row_id", "content"), KeywordStub(), "row_id", "content")


_SIG = "substring(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), 1, 80)"


@query("benchmark", f"""with g as (select * from gold where csrd_category is not null and content is not null), shots as (select content from (select *, row_number() over (partition by csrd_category order by row_id) as r from g) x where r = 1 order by csrd_category limit 3),
    held as (select * from g where {_SIG} not in (select {_SIG} from shots)), p as (select epoch, csrd_category as gold_label, {_stub_sql('content')} as pred_label from held),
    c as (select epoch, {CELLS} from p group by epoch) select epoch, tp, fp, fn, tn, {SCORES} from c""")
def benchmark(spark, d):
    """Held-out rows without those of the prompt's examples, labelled by a model and scored by period."""
    g = bind(spark, d, "gold").where("csrd_category is not null and content is not null")
    held = joins.without_signatures(g, ranking.one_of_each(g, "csrd_category", ["row_id"], 3), 80)
    got = held.join(classify(held, KeywordStub(), "row_id", "content"), "row_id").where("error is null")
    return metrics.scores(metrics.relevance(got.withColumnRenamed("csrd_category", "gold_label"), ["epoch"]))


@query("annotation_columns", "select row_id, epoch, csrd_category, chain_of_thought, cast(null as int) as materialite_score, cast(null as boolean) as materialite_impact, 'v1.0' as prompt_version, false as annotation_validated from gold")
def annotation_columns(spark, d):
    """The columns of an annotation round beside those that are there."""
    return publish.with_annotation_columns(bind(spark, d, "gold")).select("row_id", "epoch", "csrd_category", "chain_of_thought", "materialite_score", "materialite_impact", "prompt_version", "annotation_validated")


_SHOWN = cte("gold_predictions") + f", p as (select row_id, pred_label from gold_predictions where model = 'm1'), g as (select {_SIG} as sig, min(row_id) as row_id from gold where content is not null group by 1)"


@query("demo_verdict", _SHOWN + f""" select c.row_id, g.row_id as gold_row, case when g.row_id is null then 'unknown' when p.pred_label is null then 'invalid' when p.pred_label <> h.csrd_category then 'wrong' else 'right' end as verdict
    from (select row_id, {_SIG} as sig from gold union all select row_id + 1000000, {_SIG} from corpus) c left join g on c.sig = g.sig left join p on p.row_id = g.row_id left join gold h on h.row_id = g.row_id""")
def demo_verdict(spark, d):
    """Texts looked up among the held-out rows by their beginning, with a verdict on the stored
    prediction of one model."""
    gold, corpus = bind(spark, d, "gold"), bind(spark, d, "corpus")
    texts = gold.select("row_id", "content").unionByName(corpus.select((F.col("row_id") + 1_000_000).alias("row_id"), "content"))
    p = bind(spark, d, "gold_predictions").where("model = 'm1'").select(F.col("row_id").alias("found"), "pred_label")
    got = joins.prefix_lookup(texts, gold, "row_id", 80).join(p, "found", "left").join(gold.select(F.col("row_id").alias("found"), "csrd_category"), "found", "left")
    verdict = F.when(F.col("found").isNull(), "unknown").when(F.col("pred_label").isNull(), "invalid").when(F.col("pred_label") != F.col("csrd_category"), "wrong").otherwise("right")
    return got.select("row_id", F.col("found").alias("gold_row"), verdict.alias("verdict"))


@query("probe_hidden_states")
def probe_hidden_states(spark, d):
    """Accuracy by layer of a probe on the states of a stand-in encoder for the held-out rows."""
    g = bind(spark, d, "gold").where("csrd_category is not null")
    h = hidden_states(g, HashedEncoder(), "row_id", "content", "mean").join(g.select("row_id", F.col("csrd_category").alias("label")), "row_id")
    return probe.cross_validated(h.select("layer", F.col("row_id").alias("id"), "label", "features"))
