"""Every registered query beside its SQL on the smallest tables; those without SQL must run."""

import hashlib

import pytest
from oracle import connect, difference

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


CORE = sorted(q for q in entry.queries() if not q[1:2].isdigit())


@pytest.mark.parametrize("name", [q for q in CORE if q in entry.oracle_sql()])
def test_equals_sql(spark, data, con, name):
    assert difference(entry.queries()[name](spark, data), entry.oracle_sql()[name], con) is None


def run(spark, data, name):
    return entry.queries()[name](spark, data)


def test_what_has_no_sql_is_checked_below():
    assert {q for q in CORE if q not in entry.oracle_sql()} == {"bootstrap_kappa_ci", "bootstrap_f1_ci", "corpus_paragraphs", "probe_cv_accuracy", "best_layer", "permutation_p", "probe_hidden_states"}


@pytest.mark.parametrize("name,figure", [("bootstrap_kappa_ci", "kappa"), ("bootstrap_f1_ci", "f1")])
def test_intervals_hold_the_figures_of_all_models(spark, data, name, figure):
    want = {r["model"]: r[figure] for r in run(spark, data, "metrics_suite").collect()}
    got = {r["model"]: r for r in run(spark, data, name).collect()}
    assert set(got) == set(want) == {"m1", "m2", "m3"}
    for m, r in got.items():
        assert r["low"] < r["value"] < r["high"] and r["high"] - r["low"] < 0.5
        if figure == "f1":
            p = entry.queries()["prf_binary"](spark, data).where(f"model = '{m}'").first()
            assert abs(r["value"] - p["f1"]) < 0.2  # missing predictions count as none here


def test_corpus_paragraphs(spark, data):
    got = run(spark, data, "corpus_paragraphs").collect()
    assert got and all(15 <= len(r["content"].split()) and r["paragraph_id"] == hashlib.sha256(r["content"].encode()).hexdigest()[:32] for r in got)


def test_probes(spark, data):
    layers = {r["layer"]: r["accuracy_mean"] for r in run(spark, data, "probe_cv_accuracy").collect()}
    assert set(layers) == {0, 1} and all(0 <= x <= 1 for x in layers.values())
    best = run(spark, data, "best_layer").first()
    assert best["accuracy_mean"] == max(layers.values())
    p = run(spark, data, "permutation_p").first()
    assert 0 < p["p"] <= 1 and abs(p["p"] * 201 - round(p["p"] * 201)) < 1e-9 and 0 <= p["null_mean"] <= 1
    states = {r["layer"]: r["accuracy_mean"] for r in run(spark, data, "probe_hidden_states").collect()}
    assert set(states) == {0, 1, 2} and max(states.values()) > 0.2


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
