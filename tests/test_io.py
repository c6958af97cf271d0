"""Sources, sinks and the stream."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import sinks, tabular, workbook
from corpusloom.streaming import ingest


def test_export_probing(spark, tmp_path):
    p = tmp_path / "e_2.csv"
    p.write_bytes("﻿Société;ISIN;Date;Titre;URL;Langue\nÉna;X;2020;T;u;fr\n".encode())
    got = tabular.read_export(spark, str(p))
    assert got.columns[0] == "Société" and got.first()["Société"] == "Éna"
    q = tmp_path / "e_3.csv"
    q.write_bytes("Société,ISIN,Date,Titre,URL,Langue\nÉna,X,2020,T,u,fr\n".encode("latin-1"))
    assert tabular.probe_csv(spark, str(q)) == (",", "latin-1") and tabular.read_export(spark, str(q)).first()[0] == "Éna"
    assert tabular.newest(spark, str(tmp_path / "e_*.csv")).endswith("e_3.csv")


def test_json_lines_and_checkpoint(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"pair_id": "a", "n": 1}\n\n{"pair_id": "b"\n')
    good, bad = tabular.read_json_lines(spark, str(p), "pair_id string, n int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and bad.count() == 1
    q = tmp_path / "c.json"
    q.write_text(json.dumps({"k1": {"pair_id": "x", "n": 3}, "k2": {"pair_id": "y", "n": 4}}))
    assert sorted(r["n"] for r in tabular.read_records(spark, str(q), "pair_id string, n int").collect()) == [3, 4]
    assert tabular.read_records(spark, str(p), "pair_id string, n int").count() == 1


def test_tensor_and_hash(spark, tmp_path):
    np.savez(tmp_path / "t.npz", h=np.arange(12, dtype=np.float32).reshape(2, 3, 2))
    got = tabular.read_tensor(spark, str(tmp_path / "t.npz"), "h")
    assert got.count() == 6 and got.where("example_id = '1' and layer = 2").first()["features"] == [10.0, 11.0]
    assert len(tabular.file_hashes(spark, str(tmp_path / "t.npz")).first()["sha256"]) == 64


def test_fetch_codes(spark):
    def get(u):
        if u == "t":
            raise TimeoutError
        return {"a": (200, "application/pdf", b"%PDF-"), "b": (404, "", b""), "c": (200, "text/html", b"x" * 50)}[u]

    got = {r["url"]: r for r in tabular.fetch(spark.createDataFrame([("a",), ("b",), ("c",), ("t",)], "u string"), "u", get, 40).collect()}
    assert got["a"]["kind"] == "pdf" and [got[k]["error"] for k in "bct"] == ["http_404", "too_large", "timeout"]
    text = tabular.pdf_text(spark.createDataFrame([("a", "pdf", b"%PDF-", None)], "url string, kind string, body binary, error string"), extract=lambda data, n: ["mot " * 20, " ", "fin"])
    assert text.first()["text"].endswith("\n\nfin")


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    workbook.write_workbook(path, {"Lisez-moi": (["x"], []), "Annotation": (["id", "label", "note"], [["a & b", None, 3], ["c", "E1", 2.5]])}, {("Annotation", "label"): ["none", "E1"]})
    df = workbook.read_workbook(spark, path, "Annotation")
    assert df.columns == ["id", "label", "note"] and [tuple(r) for r in df.collect()] == [("a & b", None, "3"), ("c", "E1", "2.5")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "oui", "1.5", '["x"]'), ("b", "non", "zz", None)], "k string, f string, n string, j string")
    sinks.write_parquet(df, str(tmp_path / "p"), ["n", "k", "j", "f", "lost"], {"f": "boolean", "n": "double", "j": "array<string>"})
    got = spark.read.parquet(str(tmp_path / "p"))
    assert got.columns == ["n", "k", "j", "f"] and {(r["n"], r["f"]) for r in got.collect()} == {(1.5, True), (None, False)}
    for _ in range(2):
        sinks.append_csv(got, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    sinks.write_json_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    meta = sinks.run_metadata(str(tmp_path / "m.json"), None, {"seed": 42}, counts=df.groupBy("f").count())
    assert json.loads((tmp_path / "m.json").read_text())["parameters"] == {"seed": 42} and len(meta["counts"]) == 2
    assert r"a\_b & 0.500 \\" in sinks.latex_table(spark.createDataFrame([("a_b", 0.5)], "x string, y double"), ["x", "y"], "c", "l")


def test_run_metadata_is_never_cut(spark, tmp_path):
    path = tmp_path / "m.json"
    with pytest.raises(ValueError):
        sinks.run_metadata(str(path), counts=spark.range(10_001))
    assert not path.exists() and len(sinks.run_metadata(str(path), counts=spark.range(10_000))["counts"]) == 10_000


def test_stream_resumes(spark, tmp_path):
    src, work = str(tmp_path / "src"), str(tmp_path / "work")
    one = " ".join(["mot"] * 20)
    spark.createDataFrame([(1, one), (2, None), (3, "court")], "doc_id long, text string").coalesce(1).write.parquet(src)
    assert ingest.ingest_paragraphs(spark, src, work, 1).count() == 1
    spark.createDataFrame([(4, f"{one}\n\n{one}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    got = ingest.ingest_paragraphs(spark, src, work, 1)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 4, 4]


def test_remaining(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "id int")
    ledger = spark.createDataFrame([(0, "done"), (1, "failed"), (2, "failed"), (2, "done")], "id int, status string")
    assert sorted(r["id"] for r in ingest.remaining(df, ledger, "id").collect()) == [3]
    assert sorted(tuple(r) for r in ingest.remaining(df, ledger, "id", True).collect()) == [(1, "retry"), (3, "new")]


def test_windows_on_a_stream(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    table = ingest.hourly(spark.read.parquet(f"{data}/events.parquet")).agg(F.sum("n")).first()[0]
    stream = ingest.hourly(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == table


def test_fetch_asks_for_the_size_first(spark):
    asked = spark.sparkContext.accumulator(0)

    def get(u):
        asked.add(1)
        return 200, "text/html", b"x"

    got = {r["url"]: r["error"] for r in tabular.fetch(spark.createDataFrame([("big",), ("small",), (" ",)], "u string"), "u", get, 100, size=lambda u: 1000 if u == "big" else 0).collect()}
    assert got == {"big": "too_large", "small": None, " ": "empty_url"} and asked.value == 1


def test_publish_and_read_again(spark, tmp_path):
    df, gold = spark.range(3), spark.range(2)
    assert sinks.publish(df, gold, str(tmp_path / "out")) == {f"{tmp_path}/out/corpus/train": 3, f"{tmp_path}/out/gold/test": 2}
    assert not (tmp_path / "out").exists()
    sinks.publish(df, gold, str(tmp_path / "out"), dry_run=False, card="# Card")
    assert tabular.read_data_set(spark, "name", "corpus", "train", resolve=lambda n: str(tmp_path / "out")).count() == 3
    (tmp_path / "hub" / "corpus").mkdir(parents=True)
    df.toPandas().to_parquet(tmp_path / "hub" / "corpus" / "train-00000-of-00001.parquet")
    assert tabular.read_data_set(spark, str(tmp_path / "hub"), "corpus", "train").count() == 3


def test_artefacts_must_agree(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    with pytest.raises(FileNotFoundError):
        sinks.collect_artefacts(str(src), str(tmp_path / "t"), {})
    (src / "adapter_config.json").write_text('{"r": 16}')
    (src / "tokenizer.json").write_text("{}")
    with pytest.raises(ValueError):
        sinks.collect_artefacts(str(src), str(tmp_path / "t"), {"r": 8})
    assert not (tmp_path / "t").exists() and len(sinks.collect_artefacts(str(src), str(tmp_path / "t"), {"r": 16})) == 2


def test_confusions_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("m1", "E1", 3, 0.5), ("m2", "S1", 1, None)], "model string, gold_label string, E1 long, x double")
    sinks.write_confusions(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c" / "model=m1"), header=True).first()["E1"] == "3"
    tables = sinks.report_tables(df, df, df, df, df, df)
    assert len(tables) == 6 and "0.500" in tables["models"] and r"m2 & S1 & 1 & --" in tables["epochs"]


def test_each_key_runs_once(spark, tmp_path):
    ran = []

    def one(key, fail=None):
        if key == fail:
            raise RuntimeError(key)
        ran.append(key)
        return spark.range(2).withColumnRenamed("id", "n")

    with pytest.raises(RuntimeError):
        ingest.per_key(spark, ["a", "b"], str(tmp_path / "k"), lambda k: one(k, "b"))
    got = ingest.per_key(spark, ["a", "b"], str(tmp_path / "k"), one)
    assert ran == ["a", "b"] and got.count() == 4 and {r["key"] for r in got.collect()} == {"a", "b"}


def test_command_line(spark, capsys, data):
    from corpusloom.__main__ import main

    assert main(["list"]) == 0 and "stratum_table" in capsys.readouterr().out.split()
    assert main(["sql", "distinct_counts"]) == 0 and "count(distinct" in capsys.readouterr().out
    assert main(["sql", "no such"]) == 2 and main(["run", "distinct_counts", "--data", data, "--rows", "1"]) == 0


def test_annotation_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    df = spark.createDataFrame([(2, "2010-2014", "Avis", True, "b"), (1, None, "Avis", False, "a & <b>")], "row_id long, epoch string, doc_group string, iaa_subset boolean, content string")
    workbook.annotation_workbook(path, df, spark.createDataFrame([(1, "s1", 0.5), (2, "s1", 0.25), (3, "s2", 0.1)], "row_id long, stratum string, density double"))
    got = workbook.read_workbook(spark, path, "Annotation").collect()
    assert [r["row_id"] for r in got] == ["1", "2"] and got[0]["content"] == "a & <b>" and got[0]["csrd_category"] is None
    assert [tuple(r) for r in workbook.read_workbook(spark, path, "Resume").collect()] == [("s1", "2")]
    with zipfile.ZipFile(path) as z:
        book, sheet = z.read("xl/workbook.xml").decode(), z.read("xl/worksheets/sheet4.xml").decode()
    assert book.count("<sheet ") == 7 and book.count('state="hidden"') == 2 and 'name="esrs_subcategory_E1"' in book
    assert sheet.count("<dataValidation ") == 7 and "INDIRECT(\"esrs_subcategory_\"&amp;F2)" in sheet
    with pytest.raises(Exception, match="no sheet"):
        workbook.read_workbook(spark, path, "Autre")
