"""Properties and hand-made cases of the core operators."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import dates, jsonx, text
from corpusloom.operators import agreement, filters, metrics, models, pairs, probe, quotas, ranking, stats, taxonomy
from corpusloom.operators.publish import clean
from corpusloom.schemas import normalise, to_internal


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("x")).first()["x"]


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(0, 400), min_size=1, max_size=12), st.integers(0, 900), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_exact_quota(sizes, total, floor):
    got = quotas.allocate(sizes, total, floor)
    least = {s: min(floor, n) for s, n in sizes.items()}
    assert all(least[s] <= got[s] <= sizes[s] for s in sizes)
    if sum(sizes.values()):
        assert sum(got.values()) == min(max(total, sum(least.values())), sum(sizes.values()))


def test_kappa_of_archived_cells(spark):
    cells = [(0, 0, 62), (0, 1, 35), (1, 0, 16), (1, 1, 27)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "g int, p int")
    assert round(agreement.kappa(df, [], "g", "p").first()["kappa"], 4) == 0.2378
    assert agreement.kappa(df, [], "p", "g").first()["kappa"] == agreement.kappa(df, [], "g", "p").first()["kappa"]
    got = stats.bootstrap(df, ["g", "p"], stats.kappa_of_cells).first()
    assert round(got["value"], 4) == 0.2378 and abs(got["low"] - 0.0787) < 0.03 and abs(got["high"] - 0.3866) < 0.03


def test_kappa_edges(spark):
    same = spark.createDataFrame([("a", "a")] * 4 + [(None, "a")], "g string, p string")
    row = agreement.kappa(same, [], "g", "p").first()
    assert row["kappa"] is None and row["agreement"] == 100 and row["n"] == 4
    perfect = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "g int, p int")
    assert agreement.kappa(perfect, [], "g", "p", "quadratic").first()["kappa"] == 1.0
    assert one(spark, agreement.band, None, "double") == "undefined" and one(spark, agreement.band, 0.2378, "double") == "fair"


@pytest.mark.parametrize("a,b,test", [(0, 0, "exact"), (3, 9, "exact"), (12, 12, "exact"), (5, 20, "chi2"), (20, 40, "chi2")])
def test_mcnemar(spark, a, b, test):
    rows = [(i, m, ok) for i in range(a) for m, ok in (("x", True), ("y", False))]
    rows += [(a + i, m, ok) for i in range(b) for m, ok in (("x", False), ("y", True))]
    rows += [(1000, "x", True), (1000, "y", True), (2000, "x", True)]
    got = stats.mcnemar(spark.createDataFrame(rows, "id int, m string, ok boolean"), "id", "m", "ok").first()
    n = a + b
    p = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n) if test == "exact" else math.erfc(math.sqrt((abs(a - b) - 1) ** 2 / n / 2))
    assert (got["only_a"], got["only_b"], got["n"], got["test"]) == (a, b, n + 1, test) and abs(got["p"] - p) < 1e-5


def test_policies(spark):
    df = spark.createDataFrame([("none", None), ("E1", "none"), ("E1", "PARSE_ERROR"), ("S1", "S1")], "gold_label string, pred_label string")
    assert metrics.with_policy(df, "drop").count() == 2
    none = {r["pred_label"] for r in metrics.with_policy(df, "as_none").collect()}
    assert none == {"none", "S1"}
    cells = metrics.relevance(metrics.with_policy(df, "as_error"), []).first().asDict()
    assert cells == {"tp": 2, "fp": 1, "fn": 1, "tn": 0}


def test_empty_epoch_has_null_rate(spark):
    df = spark.createDataFrame([("2010-2014", "E1", None)], "epoch string, gold_label string, pred_label string")
    epochs = spark.createDataFrame([("2010-2014",), ("2015-2019",)], "epoch string")
    got = {r["epoch"]: r for r in metrics.miss_rates(df, epochs).collect()}
    assert got["2015-2019"]["fnr"] is None and got["2010-2014"]["fnr"] == 0.0 and got["2010-2014"]["fnr_as_none"] == 1.0


def test_words_and_sentences(spark):
    for value, words in ((None, 0), ("", 0), ("   ", 0), ("a b c d", 4)):
        assert one(spark, text.word_count, value) == words
    assert one(spark, text.sentence_count, "Une phrase.") == 2
    assert one(spark, text.alpha_ratio, "") == 0.0 and one(spark, text.alpha_ratio, None) is None
    assert one(spark, text.passes_quality, None) is False
    assert one(spark, text.is_structural, " Page 3 sur 47 ") and not one(spark, text.is_structural, "Une page 3.")


def test_paragraph_fold(spark):
    raw = "RAPPORT ANNUEL\nune ligne\nqui finit ici.\nautre ligne de plus de quinze mots pour ne pas fermer le bloc tout de suite alors que.\n\nfin"
    got = one(spark, text.rebuild_blocks, raw)
    assert got == ["RAPPORT ANNUEL", "une ligne qui finit ici.", "autre ligne de plus de quinze mots pour ne pas fermer le bloc tout de suite alors que.", "fin"]
    long = " ".join(["mot"] * 400) + "."
    assert one(spark, text.pack_sentences, long) == [long]
    assert one(spark, text.paragraphs, "court") == []


def test_quartiles_with_ties(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.0, 0.5)], "s double")
    cuts = df.agg(F.percentile("s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"))
    got = {r["q"] for r in df.crossJoin(cuts).select(text.quartile_label(F.col("s"), F.col("cuts")).alias("q")).collect()}
    assert got == {"q0_low", "q3_high"}


def test_dates(spark):
    for value, want in (("2014-03-02 10:00", "2014-03-02"), ("02/03/2014", "2014-03-02"), ("20140302", "2014-03-02"), ("2014-13-45", None), ("nope", None), (None, None)):
        got = one(spark, dates.lenient_date, value)
        assert (str(got) if got else None) == want
    assert one(spark, dates.open_epoch, 1995, "int") == "2010-2014" and one(spark, dates.year_bucket, 1995, "int") == "other_year"
    assert one(spark, dates.open_epoch, None, "int") == "unknown"


def test_json(spark):
    broken = "Réponse : {'csrd_category': 'E1', 'esrs_subcategory': None,}"
    assert one(spark, jsonx.repaired_category, broken) == "E1"
    assert one(spark, jsonx.repaired_category, "rien") is None and one(spark, jsonx.repaired_category, None) is None
    assert one(spark, jsonx.tolerant, '{" CSRD_Category ": "E1", "rationale": "x"}')["category"] == "E1"
    assert tuple(one(spark, jsonx.tolerant, "rien")) == ("none", "", "")
    assert one(spark, jsonx.validity, '{"csrd_category": "E1", "chain_of_thought": " "}') == "rationale"


def test_annotation_rules(spark):
    schema = "csrd_category string, esrs_subcategory string, materialite_score int, materialite_financiere boolean, materialite_impact boolean, market_surprise string, horizon_temporel string, chain_of_thought string, confiance_annotation double"
    good = ("E1", "E1-6", 4, True, False, "faible", "court_terme", "Émissions en baisse nette.", 0.9)
    rows = [good, ("none", *good[1:]), ("ZZ", *good[1:]), (None,) * 9]
    got = [r["errors"] for r in taxonomy.annotation_errors(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == [] and "materialite_score doit être 0" in got[1] and got[2] == got[3] == ["csrd_category invalide"]
    assert len(taxonomy.CODES) == 12 and sum(map(len, taxonomy.SUBCODES.values())) == 74


@pytest.mark.parametrize("counts,how,want", [((318, 8, 5), {"ratio_to_guardrail": 1e9}, (300, 8, 5)), ((318, 8, 5), {}, (65, 8, 5)), ((400, 30, 15), {}, (225, 30, 15))])
def test_caps(spark, counts, how, want):
    rows = [(t, f"{t}{i}") for t, n in zip(pairs.TYPES, counts) for i in range(n)]
    got = pairs.balance(spark.createDataFrame(rows, "pair_type string, pair_id string"), "pair_id", **how).groupBy("pair_type").count()
    assert {r["pair_type"]: r["count"] for r in got.collect()} == dict(zip(pairs.TYPES, want))


def test_budget_and_oversampling(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(50)], "i int, is_pair boolean")
    assert pairs.within_budget(df, ["i"], 5, 1000).count() == 9 and pairs.within_budget(df, ["i"], 1000, 20).count() == 10
    p = spark.createDataFrame([("A_recency_fn", "x"), ("C_category_confusion", "y"), (None, None)], "pair_type string, paragraph_id string")
    assert sorted(str(r[1]) for r in pairs.oversample(p, 2).collect()) == ["None", "None", "x", "y__dup0", "y__dup1"]


def test_draws_are_stable_and_whole(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).cast("string").alias("k"))
    q = spark.createDataFrame([("true", 20), ("false", 5000)], "k string, quota long")
    a, b = (sorted(r["id"] for r in ranking.draw(df.repartition(n), "k", q, "id", 1).collect()) for n in (1, 7))
    assert a == b and len(a) == 20 + 666
    ids = sorted((r["id"], r["n"]) for r in ranking.dense_id(df.select("id"), ["id"], "n").collect())
    assert ids == [(i, i) for i in range(1000)]


def test_split_keeps_training_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 99)], "s string, id int")
    got = {(r["s"], r["part"]): r["count"] for r in ranking.split(df, ["s"], "id", 0.12, 1).groupBy("s", "part").count().collect()}
    assert got == {("a", "val"): 4, ("a", "train"): 26, ("b", "train"): 1}


def test_schema_and_publish(spark):
    df = spark.createDataFrame([(1, None, "x", "p"), (2, "b", " ", "q"), (3, "c", "y", "p")], "row_id long, author string, content string, paragraph_id string")
    both = df.withColumn("emetteur", F.lit("e"))
    got = normalise(both, {"author": ["author", "emetteur"], "missing": ["nowhere"]})
    assert [tuple(r) for r in got.collect()] == [("e", None)] * 3
    assert to_internal(both).columns == both.columns
    held = df.where("false")
    assert sorted((r["row_id"], r["source_row"]) for r in clean(df, held).collect()) == [(0, 1), (1, 3)]
    assert clean(df, held, dedupe=True).count() == 1 and clean(df.where("false"), held).count() == 0


def test_column_detection():
    names = ["Société", "ISIN", "Date de publication", "Titre", "URL"]
    got = filters.detect_columns(names, {"date": ["date"], "url": ["url", "lien"], "titre": ["titre"], "lei": ["lei"]}, ("date", "url", "titre"))
    assert got == {"date": "Date de publication", "url": "URL", "titre": "Titre", "lei": None}
    with pytest.raises(ValueError):
        filters.detect_columns(["a"], {"url": ["url"]}, ("url",))


def test_models(spark):
    df = spark.createDataFrame([(1, "Le climat change"), (2, None)], "id int, t string")
    got = {r["id"]: r for r in models.classify(df, models.KeywordStub(), "id", "t").collect()}
    assert got[1]["pred_label"] == "E1" and got[2]["pred_label"] == "none" and got[1]["error"] is None

    def failing(texts):
        raise RuntimeError("boom")

    assert {r["error"] for r in models.classify(df, failing, "id", "t").collect()} == {"boom"}
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 429")
        return "ok"

    assert models.retrying(flaky, 3, 60, waits.append) == "ok" and waits == [60, 120]
    seen = models.annotate(df.where("id = 1"), lambda t, e: json.dumps(len(e)), lambda a: ["again"] if a == "0" else [], "id", "t").first()
    assert seen["tries"] == 2 and seen["errors"] == []


def test_probe_finds_a_separable_layer(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.r_[rng.normal(size=4), rng.normal(size=4) + 4 * (i % 2)]], i % 2) for i in range(60)]
    got = {r["layer"]: r["accuracy_mean"] for r in probe.cross_validated(probe.layers(spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int"), 2)).collect()}
    assert got[1] > 0.95 > got[0]


def test_permutation_query_has_the_draws_of_the_reference(spark, data):
    from corpusloom.plans.queries_pairs import permutation_p

    p = permutation_p(spark, data).first()["p"] * 201
    assert p >= 1 - 1e-9 and abs(p - round(p)) < 1e-9


def test_filters_on_empty_tables(spark):
    df = spark.createDataFrame([], "row_id int, lang string")
    assert filters.where_or_all(df, filters.member(F.col("lang"), ["fr"])).count() == 0
    assert [r["n"] for r in filters.funnel(df, {"fr": filters.member(F.col("lang"), ["fr"])}).collect()] == [0, 0]


# p of Student's t, by tables
@pytest.mark.parametrize("t,df,p", [(1.0, 1, 0.5), (4.302653, 2, 0.05), (3.182446, 3, 0.05), (2.776445, 4, 0.05), (2.570582, 5, 0.05), (2.228139, 10, 0.05), (2.750, 30, 0.01), (-2.750, 30, 0.01), (0.0, 7, 1.0)])
def test_t_tail(spark, t, df, p):
    got = spark.range(1).select(stats.t_tail(F.lit(t), F.lit(df).cast("long")).alias("p")).first()["p"]
    assert abs(got - p) < 1e-4


def test_t_tail_without_degrees_of_freedom(spark):
    assert spark.range(1).select(stats.t_tail(F.lit(1.0), F.lit(0).cast("long")).alias("p")).first()["p"] is None


def test_suite_of_a_model_with_equal_f1_in_all_periods(spark):
    data = [(m, e, "E1", "none" if m == "b" and e == taxonomy.EPOCHS[0] and i else "E1") for m in "ab" for e in taxonomy.EPOCHS for i in range(6)]
    got = {r["model"]: r for r in metrics.suite(spark.createDataFrame(data, "model string, epoch string, gold_label string, pred_label string")).collect()}
    assert math.isnan(got["a"]["rho"]) and [got["a"][c] for c in ("p_rho", "n_points", "slope", "r2", "p_ols")] == [0.0, 4, 0.0, 1.0, None]
    assert got["b"]["rho"] == 0.774597 and got["b"]["p_rho"] == 0.225403


def test_spearman_of_equal_values(spark):
    series = {"equal": [0.705] * 4, "one": [0.7], "two": [0.7, 0.7], "up": [0.1, 0.2, 0.3, 0.4], "down": [0.4, 0.3, 0.2], "tied": [0.1, 0.1, 0.2, 0.3]}
    df = spark.createDataFrame([(m, x, y) for m, ys in series.items() for x, y in enumerate(ys)], "model string, x int, f1 double")
    got = {r["model"]: (r["n_points"], r["rho"], r["p_rho"]) for r in stats.spearman(df, ["model"], "x", "f1").collect()}
    equal = got.pop("equal")
    assert equal[0] == 4 and math.isnan(equal[1]) and equal[2] == 0.0
    assert got == {"one": (1, None, None), "two": (2, None, None), "up": (4, 1.0, 0.0), "down": (3, -1.0, 0.0), "tied": (4, 0.948683, 0.051317)}


def test_reduced_quotas_give_back_what_floors_take(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 500), *[(f"s{i}", 3) for i in range(20)], *[(f"t{i}", 9) for i in range(10)]], "stratum string, size long")
    got = {r["stratum"]: r["quota"] for r in quotas.reduced(sizes, 200, 5).collect()}
    plain = {r["stratum"]: r["quota"] for r in quotas.proportional(sizes, 200, 5).collect()}
    assert sum(plain.values()) > 200 and sum(got.values()) < sum(plain.values())
    assert all(got[s] == 3 for s in got if s[0] == "s") and all(got[s] == 5 for s in got if s[0] == "t") and got["a"] > got["b"] > 5
    assert quotas.reduced(sizes.where("false"), 200, 5).count() == 0


def test_both_models_and_hidden_states(spark):
    df = spark.createDataFrame([(1, "La trajectoire carbone."), (2, "Rien."), (3, None)], "row_id long, content string")
    got = {r["row_id"]: (r["silver_category"], r["base_category"]) for r in models.both(df, models.KeywordStub(), models.Labelled("content")).collect()}
    assert got[1] == ("E1", "La trajectoire carbone.") and got[2][0] == "none"
    last = models.hidden_states(df, models.HashedEncoder(2, 8), "row_id", "content")
    assert last.count() == 4 and len(last.first()["features"]) == 8
    mean = models.hidden_states(df.where("row_id = 2"), models.HashedEncoder(2, 8), "row_id", "content", "mean").collect()
    assert [r["features"] for r in mean] == [r["features"] for r in last.where("row_id = 2").collect()]  # one word
    with pytest.raises(ValueError):
        models.hidden_states(df, models.HashedEncoder(), "row_id", "content", "first")


def test_padded_examples(spark):
    own = spark.createDataFrame([("a", "x")], "label string, content string")
    defaults = spark.createDataFrame([(1, "b", "y"), (2, "c", None)], "i int, label string, content string")
    got = [tuple(r) for r in ranking.padded(own, ["label"], defaults, ["i"], 2).orderBy("place").select("place", "label").collect()]
    assert got == [(1, "a"), (2, "b")]
    prompt = text.n_shot(ranking.padded(own, ["label"], defaults, ["i"], 5), "place", "content", "label").first()
    assert prompt["n"] == 3 and prompt["prompt"].endswith("Exemple 3 :\nExtrait : «»\nRéponse : c")
    assert text.n_shot(ranking.padded(own.where("false"), ["label"], defaults.where("false"), ["i"], 5), "place", "content", "label").first()["n"] == 0


def test_word_features_of_odd_texts(spark):
    df = spark.createDataFrame([(None,), ("",), (" \u2003\n",), ("un\u00a0deux  UN",)], "c string")
    got = [tuple(r) for r in df.select(text.measures(F.col("c")).alias("m")).select("m.n_words", "m.alpha_ratio", "m.unique_ratio").collect()]
    assert got[0] == (0, None, None) and got[1] == (0, 0.0, 0.0) and got[2][0] == 0 and got[3][0] == 3 and abs(got[3][2] - 2 / 3) < 1e-9
    assert df.where(text.passes_quality(F.col("c"))).count() == 0
    assert [r["s"] for r in df.select(text.scored(F.col("c")).alias("s")).collect()] == [None] * 4
