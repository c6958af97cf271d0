"""Queries on classification metrics, agreement, significance and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, metrics, stats
from ..operators.filters import without_errors
from ..operators.joins import paired
from ..operators.taxonomy import CATEGORIES, CODES, EPOCHS, HORIZONS, SURPRISE, rank
from .bindings import bind, cte
from .registry import query

P = cte("predictions")
OK = P + ", ok as (select * from predictions where coalesce(trim(error), '') = '')"
Q = "'" + "', '".join(CODES) + "'"


def div(a: str, b: str) -> str:
    return f"round(cast({a} as double) / nullif({b}, 0), 6)"


def div0(a: str, b: str) -> str:
    return f"coalesce({div(a, b)}, 0.0)"


def ok(spark, d):
    return without_errors(bind(spark, d, "predictions"))


def epochs(spark):
    return spark.createDataFrame([(e,) for e in EPOCHS], "epoch string")


@query("label_frequencies", "select type_document, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from corpus where type_document is not null group by type_document")
def label_frequencies(spark, d):
    return metrics.frequencies(bind(spark, d, "corpus"), "type_document")


@query("distinct_counts", "select count(distinct document_id) as documents, count(distinct emetteur) as issuers, count(distinct paragraph_id) as paragraphs from corpus")
def distinct_counts(spark, d):
    return bind(spark, d, "corpus").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("emetteur").alias("issuers"), F.count_distinct("paragraph_id").alias("paragraphs"))


_EP = "(" + " union all ".join(f"select '{e}' as epoch" for e in EPOCHS) + ") e"


@query("crosstab", "with p as (select pair_type, epoch from pairs) select e.epoch, " + ", ".join(f"cast(count(case when pair_type = '{t}' then 1 end) as bigint) as \"{t}\"" for t in ("A_recency_fn", "B_false_positive", "C_category")) + f" from {_EP} left join p on e.epoch = p.epoch group by e.epoch")
def crosstab(spark, d):
    return metrics.crosstab(bind(spark, d, "pairs"), "epoch", epochs(spark), "pair_type", ["A_recency_fn", "B_false_positive", "C_category"])


@query("confusion_multi", OK + " select model, gold_label, " + ", ".join(f"cast(count(case when pred_label = '{c}' then 1 end) as bigint) as \"{c}\"" for c in CODES) + f" from ok where gold_label in ({Q}) and pred_label in ({Q}) group by model, gold_label")
def confusion_multi(spark, d):
    return metrics.confusion(ok(spark, d), CODES, ["model"])


REL = "gold_label is distinct from 'none'"
PRED = "pred_label is distinct from 'none'"
CELLS = f"cast(sum(case when {REL} and {PRED} then 1 else 0 end) as bigint) as tp, cast(sum(case when not ({REL}) and {PRED} then 1 else 0 end) as bigint) as fp, cast(sum(case when {REL} and not ({PRED}) then 1 else 0 end) as bigint) as fn, cast(sum(case when not ({REL}) and not ({PRED}) then 1 else 0 end) as bigint) as tn"
SCORES = f"{div('tp + tn', 'tp + fp + fn + tn')} as accuracy, {div0('tp', 'tp + fp')} as precision, {div0('tp', 'tp + fn')} as recall, {div0('2 * tp', '2 * tp + fp + fn')} as f1, {div('fn', 'tp + fn')} as fnr, {div('fp', 'fp + tn')} as fpr"


@query("confusion_binary", OK + f" select model, {CELLS} from ok group by model")
def confusion_binary(spark, d):
    return metrics.relevance(ok(spark, d), ["model"])


@query("prf_binary", OK + f", c as (select model, {CELLS} from ok group by model) select model, tp, fp, fn, tn, {SCORES} from c")
def prf_binary(spark, d):
    return metrics.scores(metrics.relevance(ok(spark, d), ["model"]))


@query("model_metrics", OK + f", c as (select model, epoch, {CELLS} from ok group by model, epoch) select model, epoch, tp, fp, fn, tn, {SCORES} from c")
def model_metrics(spark, d):
    return metrics.scores(metrics.relevance(ok(spark, d), ["model", "epoch"]))


@query("accuracy_multi", OK + f" select model, {div('sum(case when gold_label is not distinct from pred_label then 1 else 0 end)', 'count(*)')} as accuracy from ok group by model")
def accuracy_multi(spark, d):
    hit = F.col("gold_label").eqNullSafe(F.col("pred_label"))
    return ok(spark, d).groupBy("model").agg(metrics.ratio(F.count_if(hit), F.count("*")).alias("accuracy"))


def _label_f1(rows: str, by: str) -> str:
    return f"""l as (select {by}, label, cast(sum(hit * g) as bigint) as tp, cast(sum(g) as bigint) as n_gold, cast(sum(p) as bigint) as n_pred from (
        select {by}, gold_label as label, 1 as g, 0 as p, case when gold_label is not distinct from pred_label then 1 else 0 end as hit from {rows}
        union all select {by}, pred_label, 0, 1, case when gold_label is not distinct from pred_label then 1 else 0 end from {rows}) s where label is not null group by {by}, label)"""


@query("macro_f1_rich", OK + ", rich as (select model, gold_label from ok group by model, gold_label having count(*) >= 5), k as (select ok.* from ok join rich on ok.model = rich.model and ok.gold_label = rich.gold_label), " + _label_f1("k", "model") + f" select model, round(avg(coalesce(cast(2 * tp as double) / nullif(n_gold + n_pred, 0), 0.0)), 6) as macro_f1, count(*) as n_labels from l group by model")
def macro_f1_rich(spark, d):
    return metrics.macro_f1_rich(ok(spark, d), ["model"])


@query("macro_f1_all", OK + ", e as (select model, gold_label, coalesce(pred_label, 'PARSE_ERROR') as pred_label from ok), " + _label_f1("e", "model") + f" select model, round(avg(coalesce(cast(2 * tp as double) / nullif(n_gold + n_pred, 0), 0.0)), 6) as macro_f1, count(*) as n_labels from l group by model")
def macro_f1_all(spark, d):
    return metrics.macro_f1(metrics.with_policy(ok(spark, d), "as_error"), ["model"])


@query("ovr_prf", OK + ", " + _label_f1("ok", "model") + f" select model, label, tp, n_gold, n_pred, {div0('tp', 'n_pred')} as precision, {div0('tp', 'n_gold')} as recall, {div0('2 * tp', 'n_gold + n_pred')} as f1 from l")
def ovr_prf(spark, d):
    return metrics.label_f1(ok(spark, d), ["model"])


@query("fnr_by_epoch", P + f""", g as (select model, epoch, cast(sum(case when gold_label <> 'none' then 1 else 0 end) as bigint) as r, cast(sum(case when gold_label <> 'none' and pred_label = 'none' then 1 else 0 end) as bigint) as m,
        cast(sum(case when gold_label <> 'none' and coalesce(pred_label, 'none') = 'none' then 1 else 0 end) as bigint) as mn from predictions group by model, epoch), k as (select distinct model from predictions)
    select k.model, e.epoch, coalesce(r, 0) as n_relevant, coalesce(m, 0) as n_missed, coalesce(mn, 0) as n_missed_as_none, {div('m', 'r')} as fnr, {div('mn', 'r')} as fnr_as_none from k cross join {_EP} left join g on e.epoch = g.epoch and k.model = g.model""")
def fnr_by_epoch(spark, d):
    return metrics.miss_rates(bind(spark, d, "predictions"), epochs(spark), by=["model"])


_FPR = "cast(sum(case when gold_label = 'none' then 1 else 0 end) as bigint) as n_none, cast(sum(case when gold_label = 'none' and pred_label <> 'none' then 1 else 0 end) as bigint) as n_label, cast(sum(case when gold_label = 'none' and pred_label is null then 1 else 0 end) as bigint) as n_malformed"


@query("fpr_by_epoch", P + f", g as (select model, epoch, {_FPR} from predictions group by model, epoch) select model, epoch, n_none, n_label, n_malformed, {div('n_label + n_malformed', 'n_none')} as fpr from g")
def fpr_by_epoch(spark, d):
    return metrics.false_alarm_rates(bind(spark, d, "predictions"), ["model", "epoch"])


@query("malformed_rate", P + f" select model, cast(sum(case when pred_label is null then 1 else 0 end) as bigint) as n_malformed, {div('sum(case when pred_label is null then 1 else 0 end)', 'count(*)')} as rate from predictions group by model")
def malformed_rate(spark, d):
    bad = F.col("pred_label").isNull() | (F.col("pred_label") == metrics.MALFORMED)
    return bind(spark, d, "predictions").groupBy("model").agg(F.count_if(bad).alias("n_malformed"), metrics.ratio(F.count_if(bad), F.count("*")).alias("rate"))


@query("collapse_alert", P + f", g as (select model, {_FPR} from predictions group by model) select model, {div('n_label + n_malformed', 'n_none')} as fpr, coalesce({div('n_label + n_malformed', 'n_none')} > 0.30, false) as alert from g")
def collapse_alert(spark, d):
    return metrics.collapse_alert(bind(spark, d, "predictions"), ["model"])


@query("predicted_distribution", P + " select model, coalesce(pred_label, 'PARSE_ERROR') as label, count(*) as n from predictions group by 1, 2")
def predicted_distribution(spark, d):
    return metrics.predicted_distribution(bind(spark, d, "predictions"), ["model"])


@query("baseline_fnr_by_epoch", P + f" select g.epoch, {div('''sum(case when g.gold_label <> 'none' and b.pred_label = 'none' then 1 else 0 end)''', '''sum(case when g.gold_label <> 'none' then 1 else 0 end)''')} as fnr from (select row_id, epoch, gold_label from predictions where model = 'm1') g join (select row_id, pred_label from predictions where model = 'm2') b on g.row_id = b.row_id group by g.epoch")
def baseline_fnr_by_epoch(spark, d):
    p = bind(spark, d, "predictions")
    j = p.where("model = 'm1'").select("row_id", "epoch", "gold_label").join(p.where("model = 'm2'").select("row_id", "pred_label"), "row_id")
    rel = F.col("gold_label") != "none"
    return j.groupBy("epoch").agg(metrics.ratio(F.count_if(rel & (F.col("pred_label") == "none")), F.count_if(rel)).alias("fnr"))


@query("divergence", P + ", a as (select row_id, pred_label from predictions where model = 'm1'), b as (select row_id, pred_label from predictions where model = 'm2') select count(*) as n, cast(sum(case when a.pred_label is distinct from b.pred_label then 1 else 0 end) as bigint) as n_differ, cast(sum(case when a.pred_label is null then 1 else 0 end) as bigint) as invalid_a, cast(sum(case when b.pred_label is null then 1 else 0 end) as bigint) as invalid_b from a join b on a.row_id = b.row_id")
def divergence(spark, d):
    p = bind(spark, d, "predictions")
    j = paired(p.where("model = 'm1'").select("row_id", "pred_label"), p.where("model = 'm2'").select("row_id", "pred_label"), "row_id", ("a", "b"))
    a, b = F.col("pred_label_a"), F.col("pred_label_b")
    return j.agg(F.count("*").alias("n"), F.count_if(~a.eqNullSafe(b)).alias("n_differ"), F.count_if(a.isNull()).alias("invalid_a"), F.count_if(b.isNull()).alias("invalid_b"))


@query("fnr_tidy", OK + f", m as (select distinct model from ok), c as (select model, epoch, {CELLS} from ok group by model, epoch) select m.model, e.epoch, {div('fn', 'tp + fn')} as fnr, {div0('2 * tp', '2 * tp + fp + fn')} as f1 from m cross join {_EP} left join c on c.model = m.model and c.epoch = e.epoch")
def fnr_tidy(spark, d):
    p = ok(spark, d)
    s = metrics.scores(metrics.relevance(p, ["model", "epoch"])).select("model", "epoch", "fnr", "f1")
    return p.select("model").distinct().crossJoin(F.broadcast(epochs(spark))).join(s, ["model", "epoch"], "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))


# agreement
_J = cte("annotations") + """, j as (select h.row_id, h.csrd_category as a, m.csrd_category as b, h.esrs_subcategory as ea, m.esrs_subcategory as eb, h.financial as fa, m.financial as fb, h.impact as ia, m.impact as ib, cast(h.score as int) as sa, cast(m.score as int) as sb, h.surprise as ua, m.surprise as ub, h.horizon as ha, m.horizon as hb
    from annotations h join annotations m on h.row_id = m.row_id where h.who = 'human' and m.who = 'model')"""


def _kappa_sql(variables: str, weight: str) -> str:
    w = "(a <> b)::int" if weight == "nominal" else "(a - b) * (a - b)"
    w = w.replace("a", "r.a").replace("b", "c.b") if weight != "nominal" else "case when r.a <> c.b then 1 else 0 end"
    return f"""v as ({variables}), o as (select variable, a, b, count(*) as o from v where a is not null and b is not null group by variable, a, b),
        r as (select variable, a, sum(o) as r from o group by variable, a), c as (select variable, b, sum(o) as c from o group by variable, b), t as (select variable, sum(o) as n from o group by variable),
        g as (select r.variable, n, {w} as w, cast(r.r as double) * c.c / n as e, coalesce(o.o, 0) as o, case when r.a = c.b then coalesce(o.o, 0) else 0 end as same
            from r join c on r.variable = c.variable join t on t.variable = r.variable left join o on o.variable = r.variable and o.a = r.a and o.b = c.b),
        k as (select variable, cast(max(n) as bigint) as n, round(cast(sum(same) as double) / max(n) * 100, 6) as agreement, round(1 - cast(sum(w * o) as double) / nullif(sum(w * e), 0), 6) as kappa from g group by variable)"""


def _joined(spark, d):
    a = bind(spark, d, "annotations")
    return paired(a.where("who = 'human'").drop("who", "content"), a.where("who = 'model'").drop("who", "content"), "row_id", ("human", "model"))


@query("kappa_nominal", _J + ", " + _kappa_sql("select 1 as variable, a, b from j", "nominal") + " select n, agreement, kappa from k")
def kappa_nominal(spark, d):
    return agreement.kappa(_joined(spark, d), [], "csrd_category_human", "csrd_category_model")


@query("kappa_quadratic", _J + ", " + _kappa_sql("select 1 as variable, sa as a, sb as b from j", "quadratic") + " select n, agreement, kappa from k")
def kappa_quadratic(spark, d):
    return agreement.kappa(_joined(spark, d), [], "score_human", "score_model", "quadratic")


@query("kappa_by_model", OK + ", " + _kappa_sql("select concat(model, '/', epoch) as variable, gold_label as a, coalesce(pred_label, 'none') as b from ok where epoch is not null", "nominal") + " select variable, n, agreement, kappa from k")
def kappa_by_model(spark, d):
    p = metrics.with_policy(ok(spark, d).where("epoch is not null"), "as_none").withColumn("variable", F.concat("model", F.lit("/"), "epoch"))
    return agreement.kappa(p, ["variable"], "gold_label", "pred_label")


@query("kappa_policies", P + ", " + _kappa_sql("select concat(model, '/as_none') as variable, gold_label as a, coalesce(pred_label, 'none') as b from predictions union all select concat(model, '/drop'), gold_label, pred_label from predictions where pred_label is not null", "nominal") + " select variable, n, kappa from k")
def kappa_policies(spark, d):
    p = bind(spark, d, "predictions")
    both = [metrics.with_policy(p, x).withColumn("variable", F.concat("model", F.lit(f"/{x}"))) for x in ("as_none", "drop")]
    return agreement.kappa(both[0].unionByName(both[1]), ["variable"], "gold_label", "pred_label").drop("agreement")


def _rank_sql(scale: list[str], c: str) -> str:
    return f"case {c} " + " ".join(f"when '{v}' then {i}" for i, v in enumerate(scale)) + " end"


_BAND = "case when kappa is null then 'undefined' when kappa < 0 then 'poor (worse than chance)' when kappa < 0.2 then 'slight' when kappa < 0.4 then 'fair' when kappa < 0.6 then 'moderate' when kappa < 0.8 then 'substantial' else 'almost perfect' end as band"


def _pillar_sql(c: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then '{p}'" for k, p, _ in CATEGORIES) + " else 'unknown' end"


def _bool_sql(c: str) -> str:
    return f"case when lower(trim({c})) in ('oui', 'true', '1', 'vrai', 'yes') then 'true' when lower(trim({c})) in ('non', 'false', '0', 'faux', 'no') then 'false' end"


_BOTH = "case when a <> 'none' and b <> 'none' then {} end"
_NOMINAL = [
    ("category", "a", "b"), ("pillar", _pillar_sql("a"), _pillar_sql("b")), ("subcategory", "coalesce(nullif(ea, ''), 'n/a')", "coalesce(nullif(eb, ''), 'n/a')"), ("subcategory_conditional", _BOTH.format("ea"), _BOTH.format("eb")),
    ("financial", _bool_sql("fa"), _bool_sql("fb")), ("impact", _bool_sql("ia"), _bool_sql("ib")), ("horizon", "coalesce(nullif(ha, ''), 'n/a')", "coalesce(nullif(hb, ''), 'n/a')"),
]
_ORDINAL = [("score", "sa", "sb"), ("surprise", _rank_sql(SURPRISE, "ua"), _rank_sql(SURPRISE, "ub")), ("horizon_conditional", _rank_sql(HORIZONS, "ha"), _rank_sql(HORIZONS, "hb"))]


def _each(variables: list[tuple[str, str, str]]) -> str:
    return " union all ".join(f"select '{v}' as variable, {a} as a, {b} as b from j" for v, a, b in variables)


@query("iaa_report", _J + ", n1 as (with " + _kappa_sql(_each(_NOMINAL), "nominal") + " select * from k), o1 as (with " + _kappa_sql(_each(_ORDINAL), "quadratic") + f" select * from k) select variable, n, agreement, kappa, {_BAND} from (select * from n1 union all select * from o1) z")
def iaa_report(spark, d):
    return agreement.ten_variables(_joined(spark, d), ("human", "model"), {"surprise": SURPRISE, "horizon": HORIZONS})


@query("disagreements", _J + " select row_id, concat_ws(',', case when a is distinct from b then 'csrd_category' end, case when sa is distinct from sb then 'score' end, case when ha is distinct from hb then 'horizon' end) as differs from j where a is distinct from b or sa is distinct from sb or ha is distinct from hb")
def disagreements(spark, d):
    got = agreement.disagreements(_joined(spark, d), ["csrd_category", "score", "horizon"], ("human", "model"))
    return got.select("row_id", F.concat_ws(",", "differs").alias("differs"))


# significance and drift
_CORRECT = f"(({REL}) = ({PRED}))"
_ALL = OK + f", n as (select count(distinct model) as k from ok), ids as (select row_id from ok group by row_id having count(distinct model) = (select k from n)), s as (select ok.row_id, model, {_CORRECT} as c from ok join ids on ok.row_id = ids.row_id)"


@query("mcnemar_counts", _ALL + " select a.model as model_a, b.model as model_b, count(*) as n, cast(sum(case when a.c and not b.c then 1 else 0 end) as bigint) as only_a, cast(sum(case when not a.c and b.c then 1 else 0 end) as bigint) as only_b from s a join s b on a.row_id = b.row_id and a.model < b.model group by 1, 2")
def mcnemar_counts(spark, d):
    return mcnemar_pairs(spark, d).select("model_a", "model_b", "n", "only_a", "only_b")


@query("mcnemar_exact", cte("gold_predictions") + f""", s as (select row_id, model, {_CORRECT} as c from gold_predictions), t as (select a.model as model_a, b.model as model_b, sum(case when a.c and not b.c then 1 else 0 end) as x, sum(case when not a.c and b.c then 1 else 0 end) as y from s a join s b on a.row_id = b.row_id and a.model < b.model group by 1, 2),
    k as (select *, x + y as d, least(x, y) as m from t where x + y < 25)
    select model_a, model_b, round(least(1.0, 2 * (select sum(gamma(d + 1) / (gamma(i + 1) * gamma(d - i + 1))) from range(0, cast(m as bigint) + 1) r(i)) * power(0.5, d)), 6) as p from k""")
def mcnemar_exact(spark, d):
    """The held-out rows are few, so few of them are discordant."""
    return stats.mcnemar(_scored(bind(spark, d, "gold_predictions")), "row_id", "model", "correct").where("discordant < 25").select("model_a", "model_b", "p")


def _scored(p):
    return p.withColumn("correct", ~F.col("gold_label").eqNullSafe("none") == ~F.col("pred_label").eqNullSafe("none"))


@query("mcnemar_pairs", _ALL + """, t as (select a.model as model_a, b.model as model_b, count(*) as n, cast(sum(case when a.c and not b.c then 1 else 0 end) as bigint) as only_a, cast(sum(case when not a.c and b.c then 1 else 0 end) as bigint) as only_b from s a join s b on a.row_id = b.row_id and a.model < b.model group by 1, 2),
    k as (select *, only_a + only_b as discordant, case when only_a + only_b >= 25 then power(abs(only_a - only_b) - 1, 2) / cast(only_a + only_b as double) end as x from t),
    z as (select *, sqrt(x / 2) as v from k)
    select model_a, model_b, n, only_a, only_b, discordant, case when discordant < 25 then 'exact' else 'chi2' end as test, round(x, 6) as statistic,
        round(case when discordant < 25 then least(1.0, 2 * (select sum(gamma(discordant + 1) / (gamma(i + 1) * gamma(discordant - i + 1))) from range(0, least(only_a, only_b) + 1) r(i)) * power(0.5, discordant))
            else case when v < 3 then 1 - 2 / sqrt(pi()) * exp(-v * v) * (select sum(term) from (select exp(i * ln(2.0) + (2 * i + 1) * ln(greatest(v, 1e-300)) - sum(ln(2 * i + 1)) over (order by i)) as term from range(0, 200) r(i)) q) else 0 end end, 6) as p from z""")
def mcnemar_pairs(spark, d):
    return stats.mcnemar(_scored(ok(spark, d)), "row_id", "model", "correct")


_SERIES = OK + f", c as (select model, epoch, {CELLS} from ok where epoch is not null group by model, epoch), y as (select model, case epoch " + " ".join(f"when '{e}' then {i}" for i, e in enumerate(EPOCHS)) + f" end as x, round({div0('2 * tp', '2 * tp + fp + fn')}, 3) as f1, {div('fn', 'tp + fn')} as fnr, epoch from c)"
_T = "sqrt(r2 * (n - 2) / nullif(1 - r2, 0))"
_TR = "rho * sqrt((n_points - 2) / ((1 - rho) * (1 + rho)))"


def _tail(t: str, n: str) -> str:
    """Two-sided p of Student's t for n points, three or four."""
    return f"case when {n} = 4 then 1 - abs({t}) / sqrt(2 + ({t}) * ({t})) when {n} = 3 then 1 - 2 / pi() * atan(abs({t})) end"




def _series(spark, d):
    s = metrics.scores(metrics.relevance(ok(spark, d).where("epoch is not null"), ["model", "epoch"])).withColumn("f1", F.round("f1", 3))
    return s.withColumn("x", rank(EPOCHS, F.col("epoch")))


@query("ols_drift", _SERIES + f", r as (select model, count(*) as n, arg_max(f1, x) - arg_min(f1, x) as td, regr_slope(f1, x) as slope, regr_r2(f1, x) as r2 from y group by model) select model, n as n_points, round(td, 6) as td, round(slope, 6) as slope, round(r2, 6) as r2, round({_tail(_T, 'n')}, 6) as p_ols from r where n >= 3")
def ols_drift(spark, d):
    return stats.drift(_series(spark, d), ["model"], "x", "f1")


@query("spearman_drift", _SERIES + ", r as (select model, rank() over (partition by model order by x) + (count(*) over (partition by model, x) - 1) / 2.0 as rx, rank() over (partition by model order by f1) + (count(*) over (partition by model, f1) - 1) / 2.0 as ry from y), k as (select model, count(*) as n_points, corr(rx, ry) as rho from r group by model) select model, n_points, round(rho, 6) as rho, round(case when abs(rho) > 1 - 1e-12 then 0 else " + _tail(_TR, "n_points") + " end, 6) as p_rho from k")
def spearman_drift(spark, d):
    return stats.spearman(_series(spark, d), ["model"], "x", "f1")


@query("fnr_drift", _SERIES + f", v as (select model, max(case when epoch = '{EPOCHS[0]}' then fnr end) - max(case when epoch = '{EPOCHS[-1]}' then fnr end) as dr from y group by model) select model, round(dr, 6) as fnr_drift, case when dr > 0.08 then 'strong' when dr > 0 then 'weak' else 'none' end as verdict from v")
def fnr_drift(spark, d):
    at = lambda e: F.max(F.when(F.col("epoch") == e, F.col("fnr")))
    v = _series(spark, d).groupBy("model").agg((at(EPOCHS[0]) - at(EPOCHS[-1])).alias("dr"))
    return v.select("model", F.round("dr", 6).alias("fnr_drift"), F.when(F.col("dr") > 0.08, "strong").when(F.col("dr") > 0, "weak").otherwise("none").alias("verdict"))


def _suite_sql() -> str:
    return OK + f""", c as (select model, {CELLS} from ok group by model), b as (select model, tp + fp + fn + tn as n, {SCORES},
            ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / cast((tp + fp + fn + tn) * (tp + fp + fn + tn) as double) as pe, (tp + tn) / cast(tp + fp + fn + tn as double) as po from c),
        h as (select model, {div('sum(case when gold_label is not distinct from pred_label then 1 else 0 end)', 'count(*)')} as accuracy_labels from ok group by model),
        rich as (select model, gold_label from ok where gold_label is not null group by model, gold_label having count(*) >= 5), kept as (select ok.* from ok join rich on ok.model = rich.model and ok.gold_label = rich.gold_label), {_label_f1('kept', 'model')},
        f as (select model, round(avg(coalesce(cast(2 * tp as double) / nullif(n_gold + n_pred, 0), 0.0)), 6) as macro_f1, count(*) as n_labels from l group by model),
        ce as (select model, epoch, {CELLS} from ok where epoch is not null group by model, epoch), y as (select model, case epoch {' '.join(f"when '{e}' then {i}" for i, e in enumerate(EPOCHS))} end as x, round({div0('2 * tp', '2 * tp + fp + fn')}, 3) as f1, {div('fn', 'tp + fn')} as fnr, epoch from ce),
        o as (select model, count(*) as n, arg_max(f1, x) - arg_min(f1, x) as td, regr_slope(f1, x) as slope, regr_r2(f1, x) as r2 from y where x is not null group by model),
        d as (select model, n as n_points, round(td, 6) as td, round(slope, 6) as slope, round(r2, 6) as r2, round({_tail(_T, 'n')}, 6) as p_ols from o),
        r as (select model, rank() over (partition by model order by x) + (count(*) over (partition by model, x) - 1) / 2.0 as rx, rank() over (partition by model order by f1) + (count(*) over (partition by model, f1) - 1) / 2.0 as ry from y where x is not null),
        q as (select model, count(*) as n_points, corr(rx, ry) as rho from r group by model), s as (select model, round(rho, 6) as rho, round(case when abs(rho) > 1 - 1e-12 then 0 else {_tail(_TR, 'n_points')} end, 6) as p_rho from q),
        v as (select model, round(max(case when epoch = '{EPOCHS[0]}' then fnr end) - max(case when epoch = '{EPOCHS[-1]}' then fnr end), 6) as fnr_drift from y group by model)
        select b.model, n, accuracy, precision, recall, f1, fnr, fpr, round((po - pe) / nullif(1 - pe, 0), 6) as kappa, accuracy_labels, macro_f1, n_labels, n_points, td, slope, r2, p_ols, rho, p_rho, fnr_drift
        from b left join h using (model) left join f using (model) left join d using (model) left join s using (model) left join v using (model)"""


@query("metrics_suite", _suite_sql())
def metrics_suite(spark, d):
    return metrics.suite(ok(spark, d))


def _flags(spark, d):
    p = metrics.with_policy(ok(spark, d), "as_none")
    return p.select("model", (F.col("gold_label") != "none").cast("int").alias("g"), (F.col("pred_label") != "none").cast("int").alias("p"))


@query("bootstrap_kappa_ci")
def bootstrap_kappa_ci(spark, d):
    return stats.bootstrap(_flags(spark, d), ["g", "p"], stats.kappa_of_cells, by="model")


@query("bootstrap_f1_ci")
def bootstrap_f1_ci(spark, d):
    return stats.bootstrap(_flags(spark, d), ["g", "p"], stats.f1_of_cells, by="model")


@query("majority_baseline", "with c as (select csrd_category, count(*) as n from gold where csrd_category is not null group by csrd_category) select round(max(n) / cast(sum(n) as double), 6) as majority, round(1.0 / count(*), 6) as chance, count(*) as n_classes from c")
def majority_baseline(spark, d):
    return metrics.majority_baseline(bind(spark, d, "gold"), "csrd_category")


@query("quality_report", "select count(*) as n_rows, cast(sum(case when coalesce(length(trim(content)), 0) = 0 then 1 else 0 end) as bigint) as n_empty, count(distinct paragraph_id) as n_paragraphs, count(paragraph_id) - count(distinct paragraph_id) as n_repeated, cast(sum(case when epoch is null then 1 else 0 end) as bigint) as n_no_epoch, round(avg(length(content)), 6) as mean_length, " + ", ".join(f"cast(sum(case when trim(epoch) = '{e}' then 1 else 0 end) as bigint) as n_{e.replace('-', '_')}" for e in EPOCHS) + " from corpus")
def quality_report(spark, d):
    from ..operators.publish import quality

    return quality(bind(spark, d, "corpus"))
