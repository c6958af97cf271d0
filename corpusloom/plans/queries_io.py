"""Queries that write a table, read it again and return what was read: sources and sinks."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.taxonomy import CODES
from ..runtime import shared_folder
from ..sources import sinks, tabular, workbook
from .bindings import bind, cte
from .queries_metrics import OK, Q, ok
from .registry import query


def work(spark, name: str = "") -> str:
    """A new folder of the shared one, and a name in it. The folder goes when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return f"{folder}/{name}"


_PAIR = "pair_id, coalesce(pair_type, '') as pair_type, coalesce(epoch, '') as epoch, cast(coalesce(length(prompt), 0) as bigint) as n"


def _pair(df):
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select("pair_id", text("pair_type").alias("pair_type"), text("epoch").alias("epoch"), F.length(text("prompt")).cast("long").alias("n"))


@query("export_csv", f"select {_PAIR} from pairs")
def export_csv(spark, d):
    """An export whose separator and encoding are found by probing."""
    path = work(spark, "export.csv")
    bind(spark, d, "pairs").write.csv(path, header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _pair(tabular.read_export(spark, path))


@query("newest_table", "select row_id, epoch from gold where epoch is not null")
def newest_table(spark, d):
    """The newest of several tables by the stamp in their names."""
    folder, g = work(spark), bind(spark, d, "gold")
    g.write.parquet(f"{folder}/gold_20240101.parquet")
    g.where("epoch is not null").write.parquet(f"{folder}/gold_20250101.parquet")
    return tabular.read_table(spark, f"{folder}/gold_*.parquet").select("row_id", "epoch")


@query("json_lines", f"select {_PAIR} from pairs")
def json_lines(spark, d):
    path = work(spark, "pairs.jsonl")
    sinks.write_json_lines(bind(spark, d, "pairs"), path)
    return _pair(tabular.read_json_lines(spark, path, "pair_id string, pair_type string, epoch string, prompt string")[0])


@query("checkpoint_records", "select cast(row_id as varchar) as id, csrd_category as label from gold where csrd_category is not null")
def checkpoint_records(spark, d):
    """Records of a checkpoint: one JSON object keyed by id. The held-out rows are few at every scale."""
    path, g = work(spark, "checkpoint.json"), bind(spark, d, "gold").where("csrd_category is not null")
    rows = {str(r["row_id"]): {"id": str(r["row_id"]), "label": r["csrd_category"]} for r in g.select("row_id", "csrd_category").limit(100_000).collect()}
    sinks.put(spark, path, json.dumps(rows, ensure_ascii=False).encode())
    return tabular.read_records(spark, path, "id string, label string")


@query("tensor", "select cast(i as varchar) as example_id, cast(l as bigint) as layer, cast(i * 10 + l as double) as first, cast(4 as bigint) as n from range(0, 5) a(i) cross join range(0, 3) b(l)")
def tensor(spark, d):
    """An array archive of five examples, three layers and four features."""
    data, path = io.BytesIO(), work(spark, "states.npz")
    i, layer = np.meshgrid(np.arange(5), np.arange(3), indexing="ij")
    np.savez(data, h=np.repeat((i * 10 + layer)[:, :, None], 4, axis=2).astype(np.float32))
    sinks.put(spark, path, data.getvalue())
    t = tabular.read_tensor(spark, path, "h")
    return t.select("example_id", "layer", F.col("features")[0].cast("double").alias("first"), F.size("features").cast("long").alias("n"))


@query("file_hash", "select cast(11 as bigint) as length, sha256('corpusloom' || chr(10)) as sha256")
def file_hash(spark, d):
    path = work(spark, "a.txt")
    sinks.put(spark, path, b"corpusloom\n")
    return tabular.file_hashes(spark, path).select("length", "sha256")


@query("workbook_sheet", "select cast(row_id as varchar) as row_id, csrd_category, epoch from gold")
def workbook_sheet(spark, d):
    """A sheet of a workbook with drop-down lists, all columns as strings."""
    data, path = io.BytesIO(), work(spark, "gold.xlsx")
    rows = [list(r) for r in bind(spark, d, "gold").select("row_id", "csrd_category", "epoch").limit(workbook.MOST_ROWS).collect()]
    workbook.write_workbook(data, {"Lisez-moi": (["x"], []), "Annotation": (["row_id", "csrd_category", "epoch"], rows)}, {("Annotation", "csrd_category"): CODES})
    sinks.put(spark, path, data.getvalue())
    return workbook.read_workbook(spark, path, "Annotation")


@query("typed_parquet", "select row_id, row_id % 3 = 0 as flag, case when row_id % 4 <> 0 then cast(row_id % 7 as int) end as score, epoch as first from corpus")
def typed_parquet(spark, d):
    """Strings written in their types: flags and numbers by a lenient cast, lists from their JSON."""
    path, n = work(spark, "typed.parquet"), F.col("row_id")
    text = bind(spark, d, "corpus").select("row_id", F.when(n % 3 == 0, " Oui").otherwise("non").alias("flag"), F.when(n % 4 == 0, "?").otherwise((n % 7).cast("string")).alias("score"), F.to_json(F.array("epoch")).alias("items"))
    sinks.write_parquet(text, path, ["row_id", "items", "flag", "score", "absent"], {"flag": "boolean", "score": "int", "items": "array<string>"})
    return spark.read.parquet(path).select("row_id", "flag", "score", F.col("items")[0].alias("first"))


@query("ordered_csv", cte("predictions") + " select cast(row_id as varchar) as row_id, model, coalesce(pred_label, '') as pred_label from predictions")
def ordered_csv(spark, d):
    """Predictions as CSV, preferred columns first."""
    path = work(spark, "predictions.csv")
    sinks.append_csv(sinks.ordered(bind(spark, d, "predictions").select("pred_label", "model", "row_id"), ["row_id", "model", "absent"], rest=True), path)
    got = tabular.read_table(spark, path)
    return got.select(*got.columns[:2], F.coalesce(got.columns[2], F.lit("")).alias("pred_label"))


@query("appended_csv", "select cast(doc_id as varchar) as doc_id, cast(2 as bigint) as n from documents")
def appended_csv(spark, d):
    """Two runs that add to one CSV table."""
    path = work(spark, "done.csv")
    for run in ("a", "b"):
        sinks.append_csv(bind(spark, d, "documents").select("doc_id", F.array(F.lit(run)).alias("runs")), path)
    return tabular.read_table(spark, path).groupBy("doc_id").agg(F.count_distinct("runs").alias("n"))


@query("confusion_csv", OK + f" select model, gold_label, cast(cast(count(case when pred_label = 'E1' then 1 end) as bigint) as varchar) as \"E1\" from ok where gold_label in ({Q}) and pred_label in ({Q}) group by model, gold_label")
def confusion_csv(spark, d):
    """A confusion table as one CSV for each model."""
    path = work(spark, "confusions.csv")
    sinks.write_confusions(metrics.confusion(ok(spark, d), CODES, ["model"]), path)
    return tabular.read_table(spark, path).select("model", "gold_label", "E1")


@query("published_set", "select 'corpus' as config, count(*) as n from corpus union all select 'gold', count(*) from gold")
def published_set(spark, d):
    """A data set as published: two configurations, each with its split."""
    folder = work(spark, "set")
    sinks.publish(bind(spark, d, "corpus"), bind(spark, d, "gold"), folder, dry_run=False, card="# Corpus")
    parts = [tabular.read_data_set(spark, folder, c, s).agg(F.lit(c).alias("config"), F.count("*").alias("n")) for c, s in (("corpus", "train"), ("gold", "test"))]
    return parts[0].unionByName(parts[1])


@query("run_figures", cte("predictions") + " select model, count(*) as n from predictions group by model")
def run_figures(spark, d):
    """Aggregates kept in the document of a run."""
    path = work(spark, "run.json")
    meta = sinks.metadata({"seed": 42}, models=bind(spark, d, "predictions").groupBy("model").agg(F.count("*").alias("n")))
    sinks.put(spark, path, json.dumps(meta, ensure_ascii=False).encode())
    schema = "parameters struct<seed:int>, models array<struct<model:string,n:long>>"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m")).where("m.parameters.seed = 42").select(F.inline("m.models"))


def _answer(url: str) -> tuple[int, str, bytes]:
    """What a server of the test data answers: by the last number of the address."""
    n = int(url.rsplit("/", 1)[-1])
    if n % 11 == 0:
        raise TimeoutError
    return (404, "", b"") if n % 7 == 0 else (200, "application/pdf" if n % 5 == 0 else "text/html", b"%PDF-" if n % 5 == 0 else b"<p>x</p>")


_N = "cast(regexp_extract(url, '([0-9]+)\\s*$', 1) as int)"


@query("fetch_codes", cte("metadata") + f", u as (select trim(url) as url from metadata where trim(url) <> ''), k as (select case when {_N} % 13 = 0 then 'too_large' when {_N} % 11 = 0 then 'timeout' when {_N} % 7 = 0 then 'http_404' end as error, {_N} as n from u) select coalesce(error, '') as error, case when error is null then case when n % 5 = 0 then 'pdf' else 'html' end else '' end as kind, count(*) as n from k group by 1, 2")
def fetch_codes(spark, d):
    """Outcomes of fetching the addresses of an export."""
    u = bind(spark, d, "metadata").select(F.trim("url").alias("url")).where("url <> ''")
    got = tabular.fetch(u, "url", _answer, size=lambda x: 10**8 if int(x.rsplit("/", 1)[-1]) % 13 == 0 else 0)
    return got.groupBy(F.coalesce("error", F.lit("")).alias("error"), F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"))
