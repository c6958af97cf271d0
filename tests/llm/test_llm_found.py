"""Training-data operators on small tables: against brute force, and on odd input."""

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import answers, encoding, leaks, lines, neardup, overlap, quota, scans, subjects, textform

CORPUS = "row_id bigint, document_id string, emetteur string, content string"
TEXTS = ["Le conseil d'administration a examiné les comptes annuels du groupe pour l'exercice clos et proposé un dividende stable aux actionnaires réunis en assemblée générale ordinaire à Paris."]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# p3
def test_consistent_form():
    for odd, plain in {"Ｐéｌｉｓａｎｅ": "Pélisane", "Hо̂tel": "Hôtel", "Μaltériоn": "Maltérion", "eﬀet ﬁn": "effet fin", "a b​c": "a bc", "Sаnté": "Santé"}.items():
        assert textform.consistent(odd) == plain
    for usual in ("m² CO₂ « x » — l’été œuvre", "coefficient β de 2", "Москва", ""):
        assert textform.consistent(usual) == usual


@given(st.text(alphabet="aeéАаеοβ fiﬁ́​ Ａ１1.\n", max_size=40))
@settings(max_examples=300, deadline=None)
def test_consistent_form_is_a_fixed_point(s):
    once = textform.consistent(s)
    assert textform.consistent(once) == once
    assert once.count("\n") == s.count("\n")


def test_p3_findings(spark):
    df = spark.createDataFrame([(1, "ﬁn", None), (2, None, "Sаnté"), (3, "", "ok"), (4, "β seul", "x́y"), (1, "ﬁn", None)], "row_id bigint, content string, emetteur string").withColumn("field", F.lit("clash"))
    assert rows(textform.findings(df, "row_id", ["content", "emetteur"])) == [(1, "content"), (2, "emetteur"), (4, "emetteur")]
    assert textform.findings(df.where("false"), "row_id", ["content"]).count() == 0
    table = textform.fit(df, ["content", "emetteur"])
    assert table.rewrite["ﬁ"] == "fi" and rows(textform.normalise(df, ["content"], table).where("row_id = 1").select("content"))[0] == ("fin",)


# p4
def corpus_lines(spark, more=()):
    data = [(i, f"d{i}", "Émetteur", f"Corps unique numéro {i} du texte.\n{'  PARTAGER  cette page' if i % 2 else 'Partager cette page'}\nPage {i % 2}") for i in range(6)]
    data += [(10 + i, f"e{i}", "Autre", "Phrase coupée en deux par\nle retour à la ligne commun.") for i in range(6)]
    return spark.createDataFrame(data + list(more), CORPUS).withColumn("key", F.lit("clash"))


def test_p4_lines(spark):
    got = rows(lines.repeated_lines(corpus_lines(spark, [(30, None, None, "Partager cette page"), (31, "d0", "Émetteur", None), (0, "d0", "Émetteur", "Corps")])).select("row_id", "line_no"))
    assert got == [(i, 2) for i in range(6)]
    assert lines.repeated_lines(corpus_lines(spark).where("false")).count() == 0
    clean = dict(rows(lines.without_repeated_lines(corpus_lines(spark), lines.repeated_lines(corpus_lines(spark)))))
    assert clean[0] == "Corps unique numéro 0 du texte.\nPage 0"


def test_p4_near_clusters(spark):
    data = [(i, f"d{i}", "X", f"Contact presse : bureau de la ville, poste {1000 + i}") for i in range(6)]
    df = spark.createDataFrame(data, CORPUS)
    assert lines.repeated_lines(df).count() == 0 and lines.repeated_lines(df, exact=False).count() == 6


def test_p4_join_path(spark, monkeypatch):
    df = corpus_lines(spark)
    repeated = lines.repeated_lines(df)
    want = rows(lines.without_repeated_lines(df, repeated))
    monkeypatch.setattr(lines, "sized", lambda x, limit=0: (x, False))
    assert rows(lines.without_repeated_lines(df, repeated)) == want


# p2
def shingles(text):
    w = textform.words(text)
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 20 else None


def brute_groups(data):
    sets = {i: s for i, *_, t in data if t is not None and (s := shingles(t))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
                parent[find(b)] = find(a)
    out = defaultdict(set)
    for i in ids:
        out[find(i)].add(i)
    return sorted(tuple(sorted(g)) for g in out.values() if len(g) > 1)


def edited(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"mot{rng.randrange(10**6)}"
    return " ".join(w)


def near_data(seed=1, n=40):
    rng = random.Random(seed)
    data = []
    for g in range(n):
        base = " ".join(f"g{g}w{i}" if rng.random() < 0.7 else f"commun{i % 9}" for i in range(60))
        for k in range(rng.randrange(1, 5)):
            data.append((len(data), f"d{g}", "E", edited(rng, base, rng.randrange(0, 5)) if k else base))
    return data


def test_p2_groups_against_brute_force(spark):
    data = near_data() + [(9001, "x", None, None), (9002, "x", "E", ""), (9003, "x", "E", "court")]
    data += [(9100 + i, "y", "E", TEXTS[0]) for i in range(3)] + [(9100, "y", "E", TEXTS[0])]
    df = spark.createDataFrame(data, CORPUS).withColumn("group", F.lit("clash"))
    by = defaultdict(set)
    for r in neardup.groups(df).collect():
        by[r["group"]].add(r["row_id"])
    assert sorted(tuple(sorted(g)) for g in by.values()) == brute_groups(data)
    pairs = neardup.group_pairs(neardup.groups(df))
    assert pairs.count() == sum(len(g) * (len(g) - 1) // 2 for g in by.values())
    assert neardup.groups(df.where("false")).count() == 0


def test_p2_large_nodes_walk_on(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 3)
    monkeypatch.setattr(neardup, "COUNTERS", (64, 64))
    monkeypatch.setattr(neardup, "DEPTH", 5)
    rng = random.Random(5)
    base = " ".join(f"w{i}" for i in range(80))
    data = [(i, "d", "E", edited(rng, base, 2)) for i in range(60)] + [(100 + i, "d", "E", " ".join(f"u{i}x{k}" for k in range(40))) for i in range(20)]
    got = neardup.groups(spark.createDataFrame(data, CORPUS), drop_lines=False)
    sizes = {r["group"]: r["count"] for r in got.groupBy("group").count().collect()}
    assert sizes == {0: 60}


def test_p2_hot_nodes_in_blocks_lose_no_pair(spark, monkeypatch):
    shared = " ".join(f"commun{i}" for i in range(60))
    data = [(2 * i + k, "d", "E", f"{shared} {' '.join(f'f{i}m{j}' for j in range(15))} {' '.join(f'r{i}k{k}m{j}' for j in range(30))}") for i in range(40) for k in range(2)]
    reps = neardup.word_sets(spark.createDataFrame(data, CORPUS), None, 3, 20, True).cache()
    want = rows(neardup.candidate_pairs(reps))
    monkeypatch.setattr(neardup, "NODE", 4)
    assert want and rows(neardup.candidate_pairs(reps)) == want
    node = reps.select(F.lit(7).cast("long").alias("node"), "row_id", *neardup.SKETCH)
    monkeypatch.setattr(neardup, "NODE", 16)
    assert rows(neardup._meet(neardup._blocks(node), 0.0)) == [(a, b) for a in range(80) for b in range(a + 1, 80)]


def test_p2_p5_pairs_do_not_depend_on_the_size_of_nodes(spark, monkeypatch):
    shared = " ".join(f"commun{i}" for i in range(60))
    data = [(2 * i + k, "d", "E", f"{shared} {' '.join(f'f{i}m{j}' for j in range(15))} {' '.join(f'r{i}k{k}m{j}' for j in range(20))}") for i in range(160) for k in range(2)]
    reps = neardup.word_sets(spark.createDataFrame(data, CORPUS), None, 3, 20, True).cache()
    want = rows(neardup.candidate_pairs(reps))
    monkeypatch.setattr(neardup, "NODE", 2)  # so some nodes are more than 32 times as large
    assert want and rows(neardup.candidate_pairs(reps)) == want


@pytest.mark.parametrize("size", [30, 110, 200, 400, 900, 5000])
def test_p2_sketch_keeps_pairs_at_the_threshold(size):
    rng = np.random.default_rng(size)
    trials, common = 400, 2 * size // 3  # of two sets of one size with a similarity of a half
    h = rng.integers(0, 1 << 63, size=(trials, 2 * size - common), dtype=np.uint64)
    far = rng.integers(0, 1 << 63, size=(trials, size), dtype=np.uint64)
    a, b, c = h[:, :size], h[:, size - common :], np.concatenate([h[:, : size // 10], far[:, size // 10 :]], axis=1)
    a, b, c = (neardup._sketches(np.repeat(x.ravel(), 2), np.full(trials, 2 * size)).view(np.uint64) for x in (a, b, c))  # members twice

    def passed(x, y):
        x, y = x.copy(), y.copy()
        kx, ky = (z[:, 3] >> np.uint64(56) for z in (x, y))
        x[:, 3] ^= kx << np.uint64(56)
        y[:, 3] ^= ky << np.uint64(56)
        return (np.bitwise_count(x ^ y).sum(axis=1) <= neardup.most_bits(0.5)[kx.astype(int), ky.astype(int)]).mean()

    assert passed(a, b) >= 0.99 and passed(a, a) == 1 and (size > 150 or passed(a, c) < 0.05)


def test_p2_counts_nodes_where_counters_cannot_tell(spark, monkeypatch):
    reps = neardup.word_sets(spark.createDataFrame(near_data(3, 30), CORPUS), None, 3, 20, True).cache()
    want = rows(neardup.candidate_pairs(reps))
    monkeypatch.setattr(neardup, "NODE", 4)
    monkeypatch.setattr(neardup, "COUNTERS", (16, 16))
    assert want and rows(neardup.candidate_pairs(reps)) == want


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(rows(neardup.components(chain)))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# p5
def test_p5(spark):
    data = [(i, f"d{i}", "E", TEXTS[0] + (" fin" if i == 3 else "")) for i in range(4)]
    df = spark.createDataFrame(data, CORPUS)
    splits = spark.createDataFrame([(0, " Train"), (0, "train"), (1, "TEST "), (2, None), (3, "validation")], "row_id bigint, split string")
    assert rows(overlap.found(df, splits)) == [(0, 1, "test"), (0, 3, "validation")]
    report = {r["split"]: (r["rows"], r["leaked"]) for r in overlap.exact_overlaps(df, splits).collect()}
    assert report == {"test": (1, 1), "validation": (1, 0)}
    assert overlap.found(df.where("false"), splits).count() == 0


# p6
TARGETS = "epoch string, type_document string, target_bp int, min_rows int"


def test_p6_allocation_and_draw(spark):
    data = [(i, " A " if i % 2 else "A", "Rapport" if i < 80 else "RAPPORT ") for i in range(100)] + [(200 + i, "A", None) for i in range(5)] + [(300 + i, "B", "Avis") for i in range(300)] + [(900, None, "Avis")]
    df = spark.createDataFrame(data, "row_id bigint, epoch string, type_document string").withColumn("t", F.lit("clash"))
    targets = spark.createDataFrame([("A", "Rapport", 2000, 2), ("A", "other_doc", 4000, 2), ("B", "avis", 3000, 2), ("C", "Avis", 1000, 3)], TARGETS)
    got = {r["type_document"] + r["epoch"]: r.asDict() for r in quota.allocation(df, targets).collect()}
    assert {k: v["wanted"] for k, v in got.items()} == {"RapportA": 16, "other_docA": 32, "avisB": 24, "AvisC": 8}
    assert {k: v["quota"] for k, v in got.items()} == {"RapportA": 16 + 27 + got["RapportA"]["quota"] - 43, "other_docA": 5, "avisB": got["avisB"]["quota"], "AvisC": 0}
    assert sum(v["quota"] for v in got.values()) == 80 and got["RapportA"]["quota"] >= 43
    assert rows(quota.unmet(df, targets)) == [("A", "other_doc"), ("C", "Avis")]
    sample = quota.draw(df, targets)
    assert sample.count() == 80 and sample.select("row_id").distinct().count() == 80
    assert rows(sample.select("row_id")) == rows(quota.draw(df.repartition(5), targets).select("row_id"))
    assert quota.draw(df.where("false"), targets).count() == 0 and quota.unmet(df, targets.where("false")).count() == 0


# p7
def test_p7_kinds_and_repair(spark):
    plain = [(1000 + i, f"p{i}", "P", "Le conseil présente la réduction des émissions du groupe et la formation des équipes. Le bien-être au travail reste prioritaire.") for i in range(20)]
    header = "Groupe Exemple – rapport annuel"
    scan = [
        (1, "doc", "E", f"{header}\nLe conseil présente la réduc-\ntion des émissions du groupe."),
        (2, "doc", "E", f"{header}   12\nLe consei1 présente la forrnation des équipes\net le bien-\nêtre au travail."),
        (3, "doc", "E", f"Le conseil présente la for-\n{header}\nmation des équipes.\n- 14 -"),
        (4, "doc", "E", None),
        (5, None, "E", "une ligne\nune autre."),
        (6, "doc", None, ""),
    ]
    df = spark.createDataFrame(plain + scan, CORPUS).withColumn("kind", F.lit("clash"))
    assert rows(scans.scan_noise(df)) == [(1, "header"), (1, "hyphenation"), (2, "header"), (2, "misread"), (2, "page"), (3, "header"), (3, "hyphenation"), (3, "page")]
    text = {r["row_id"]: r["content"] for r in scans.repair(df).collect()}
    assert text[1] == "Le conseil présente la réduction des émissions du groupe."
    assert text[2] == "Le conseil présente la formation des équipes et le bien-être au travail."
    assert text[3] == "Le conseil présente la formation des équipes." and text[4] is None and text[5] == "une ligne\nune autre."
    assert scans.scan_noise(df.where("false")).count() == 0


def test_p7_misread_in_one_line(spark):
    plain = [(1000 + i, f"p{i}", "P", "Le montant versé par le groupe est resté stable.") for i in range(20)]
    scan = [(1, "doc", "E", "Le rnontant versé par le groupe."), (2, "doc", "E", "Le montant versé en 2O21 par le groupe."), (3, "doc", "E", "Le montant versé en 2021.")]
    assert rows(scans.scan_noise(spark.createDataFrame(plain + scan, CORPUS))) == [(1, "misread"), (2, "misread")]


def test_p7_misread_where_all_texts_are_wrapped(spark):
    plain = [(1000 + i, f"p{i}", f"P{i}", f"Le montant versé par la société numéro {i}\nest resté stable.") for i in range(20)]
    df = spark.createDataFrame([*plain, (1, "doc", "E", "Le rnontant versé par\nla sociét6 est resté stable.")], CORPUS)
    assert rows(scans.scan_noise(df)) == [(1, "misread")]
    assert dict(rows(scans.repair(df).where("row_id = 1"))) == {1: "Le montant versé par la société est resté stable."}


def test_p7_has_no_caps(spark):
    plain = [(1000 + i, f"p{i}", "P", "Le conseil présente la désindustrialisation ooooooo du groupe et la formation des équipes.") for i in range(30)]
    header = "Groupe Exemple – rapport annuel " + " ".join(f"chapitre {chr(97 + i) * 9}" for i in range(12))
    scan = [(1, "doc", "E", f"{header}\nLe conseil présente la for-\nun.\ndeux.\ntrois.\nquatre.\nmation des équipes."), (2, "doc", "E", f"{header}\nLe conseil."), (3, "doc", "E", f"Le conseil.\n{header}"), (4, "x", "E", "Le conseil présente la d6s1ndu5tr1a1isati0n du groupe.")]
    assert len(header) > 160
    got = rows(scans.scan_noise(spark.createDataFrame(plain + scan, CORPUS)))
    assert got == [(1, "header"), (1, "hyphenation"), (2, "header"), (3, "header"), (4, "misread")]


def test_p7_readings_among_the_vocabulary():
    reader = scans.Reader({"ooooooooo": (9, 9), "ooooooool": (9, 9), "oooooooo": (9, 9)})
    per = [["o", "ô"]] * 8 + [["l", "i", "o"]]
    assert sorted(reader._among(per)) == ["ooooooool", "ooooooooo"]


# p1
@pytest.mark.parametrize(
    "answer,want",
    [
        (None, "empty"),
        ("  ", "empty"),
        ("{}", "empty"),
        ('```json\n{"csrd_category": "E1", "chain_of_thought": ""}\n```', "empty"),
        ('{"csrd_category": "E1", "chain_of_thought": "Le texte décrit la', "truncated"),
        ('{"csrd_category": "E1", "chain_of_thought": "Le texte décrit la"}', "truncated"),
        ('{"csrd_category": "no', "truncated"),
        ("Je m'abstiens d'analyser ce passage.", "refusal"),
        ('{"chain_of_thought": "Désolé, il m\'est impossible de classer ce passage."}', "refusal"),
        ('{"chain_of_thought": "The text describes the plan of the group and it is therefore relevant."}', "language"),
        ('{"chain_of_thought": "La trajectoire carbone du groupe est présentée par le conseil dans le rapport annuel."}', "copy"),
        ("{'csrd_category': 'E1', 'chain_of_thought': 'Le texte décrit la trajectoire du groupe.',}", None),
        ('{"csrd_category": "none", "chain_of_thought": "Simple formalité."}', None),
        ('{"chain_of_thought": "Je ne peux écarter une lecture plus large, mais la formulation « carbone » suffit."}', None),
    ],
)
def test_p1_defects(answer, want):
    prompt = "Extrait : «La trajectoire carbone du groupe est présentée par le conseil dans le rapport annuel. Les salariés en sont informés.»"
    assert answers.defect(prompt, answer) == want


def test_p1_table(spark):
    df = spark.createDataFrame([("a", None, None, "Une réponse complète."), ("a", None, None, "Une réponse complète.")], "pair_id string, prompt string, chosen string, rejected string").withColumn("defect", F.lit("clash"))
    assert rows(answers.defective_answers(df)) == [("a", "chosen", "empty")]
    assert answers.defective_answers(df.where("false")).count() == 0


# p8
@pytest.fixture(scope="module")
def enc():
    return encoding.encoder(encoding.VOCABULARY)


@given(st.lists(st.sampled_from(["a", "the", "'s", "'", " ", "  ", "\n", "1", "é", "漢字", "🙂", "-", "x" * 30, "ab" * 20, "'ll", "   \n ", "don't"]), max_size=40), st.sampled_from([3, 8, 16, 40]))
@settings(max_examples=300, deadline=None)
def test_p8_cut_and_joined_equals_whole(parts, limit):
    e = encoding.encoder(encoding.VOCABULARY)
    text = "".join(parts)
    pieces = encoding.halves(text, limit)
    assert "".join(pieces) == text
    assert encoding.join_tree(e, [(x, e.encode_ordinary(x)) for x in pieces]) == e.encode_ordinary(text)


def test_p8_table(spark, enc):
    texts = [None, "", "Bonjour <|endoftext|> à tous", "mot " * 50, "z" * 500, "z" * 500]
    df = spark.createDataFrame(list(enumerate(texts)) + [(4, texts[4])], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = encoding.token_ids(df, limit=64)
    assert rows(got) == sorted((i, enc.encode_ordinary(t or "")) for i, t in [*enumerate(texts), (4, texts[4])])
    assert encoding.token_ids(df.where("false")).count() == 0


def test_p8_long_rows_by_the_tree(spark, enc):
    texts = ["Le rapport annuel, n° 12, dit : « l'eau ».\n" * 400, " " * 9000 + "fin", "x" * 9000, "é'" * 5000, "漢字 et 'll " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert min(map(len, texts)) > encoding.LIMIT
    assert rows(encoding.token_ids(df)) == [(i, enc.encode_ordinary(t)) for i, t in enumerate(texts)]


# p9
def test_p9_both_paths(spark):
    w = [f"mot{i}" for i in range(40)]
    gold = spark.createDataFrame([(1, " ".join(w[:20])), (2, None), (3, "court"), (1, " ".join(w[:20]))], "row_id bigint, content string")
    docs = spark.createDataFrame([(10, "Avant. " + ", ".join(w[2:20]).upper() + " après"), (11, " ".join(w[3:20])), (12, None), (13, "")], "doc_id bigint, text string").withColumn("content", F.lit("clash"))
    assert rows(leaks.leaks(docs, gold)) == [(10, 1)] == rows(leaks.leaks(docs, gold, limit=0))
    clean = {r["doc_id"]: (r["text"], r["removed"]) for r in leaks.remove_leaks(docs, gold).collect()}
    assert clean == {r["doc_id"]: (r["text"], r["removed"]) for r in leaks.remove_leaks(docs, gold, limit=0).collect()}
    assert clean[10] == ("Avant.  après", 18) and clean[11][1] == 0 and clean[12] == (None, 0)
    assert leaks.leaks(docs.where("false"), gold).count() == 0 and leaks.leaks(docs, gold.where("false")).count() == 0


# p10
def subject_tables(spark, n=60):
    rng = random.Random(2)
    vocab = {"sport": ["stade", "équipe", "match", "ligue", "arbitre"], "droit": ["juge", "tribunal", "contrat", "litige", "clause"], "santé": ["patient", "vaccin", "soin", "médecin", "hôpital"]}

    def sentence(s):
        return f"Selon la direction, {rng.choice(vocab[s])} et {rng.choice(vocab[s])} avec {rng.choice(vocab[s])} en {2000 + rng.randrange(20)}."

    docs, labels = [], []
    for i in range(n):
        subs = rng.sample(list(vocab), 1 + i % 2)
        docs.append((i, " ".join(sentence(subs[k % len(subs)]) for k in range(8))))
        labels += [(i, s) for s in subs]
    return docs, labels


def test_p10_held_out(spark):
    docs, labels = subject_tables(spark)
    df = spark.createDataFrame([*docs, (900, None), (901, " "), (902, "Notice formelle sans objet. Rien de plus.")], "doc_id bigint, text string").withColumn("subject", F.lit("clash"))
    lab = spark.createDataFrame([x for x in labels if x[0] < 40] + [(1, None)], "doc_id bigint, subject string")
    assert rows(subjects.document_subjects(df, lab)) == sorted(labels)
    assert subjects.document_subjects(df, lab.where("false")).count() == 0 and subjects.document_subjects(df.where("false"), lab).count() == 0


def test_p10_words_that_labelled_documents_rarely_hold(spark):
    docs, labels = subject_tables(spark)
    rng = random.Random(5)
    odd = [(i, docs[i][1] + " L'annexe jointe suit.") for i in range(4) if ("sport" in {s for k, s in labels if k == i})]
    docs = [dict(odd).get(i, t) and (i, dict(odd).get(i, t)) for i, t in docs]
    notices = [(500 + i, " ".join(f"L'annexe jointe porte la mention {rng.randrange(99)}." for _ in range(6))) for i in range(60)]
    df = spark.createDataFrame(docs + notices, "doc_id bigint, text string")
    lab = spark.createDataFrame([x for x in labels if x[0] < 40], "doc_id bigint, subject string")
    assert subjects.document_subjects(df, lab).where("doc_id >= 500").count() == 0


def test_p10_splits_what_several_subjects_share():
    rng = np.random.default_rng(1)
    flat, counts, document, held = [], [], [], []
    for d in range(120):  # ten subjects, each with a term of its own beside one that all sentences have
        subject = d % 10
        held.append([float(j == subject) for j in range(10)])
        for _ in range(4):
            flat += [0, 1 + subject]
            counts.append(2)
            document.append(d)
    model = subjects.SubjectModel([f"s{j}" for j in range(10)], [f"terme{chr(97 + i)}" for i in range(11)], np.r_[3.0, rng.uniform(0.9, 1.1, 10)])
    subjects.LEAVES, before = 3, subjects.LEAVES
    try:
        grown = subjects.grow(model, np.array(flat), np.array(counts), np.array(document), np.array(held))
    finally:
        subjects.LEAVES = before
    assert len(grown.label) >= 10 and (grown.mixture.max(axis=1) == 1).all()


def test_p10_sentences():
    assert subjects.sentences("Un (réf. Nom 12) deux. Trois !\nQuatre\nsuite\n\n👍") == ["Un (réf. Nom 12) deux.", "Trois !", "Quatre\nsuite"]
