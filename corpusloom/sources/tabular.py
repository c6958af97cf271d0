"""Readers of exports and record files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators and encodings that exports come in, in order of trial.
SEPARATORS = [";", ",", "\t"]
ENCODINGS = ["utf-8", "utf-8-sig", "latin-1"]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def newest(spark: SparkSession, pattern: str) -> str:
    """The path of a glob that sorts last by name, as run stamps in names do."""
    fs, p = _fs(spark, pattern)
    found = sorted(str(s.getPath().toString()) for s in (fs.globStatus(p) or []))
    if not found:
        raise FileNotFoundError(pattern)
    return found[-1]


def probe_csv(spark: SparkSession, path: str, least: int = 5) -> tuple[str, str]:
    """Separator and encoding: the first with more than ``least`` columns in the header. Only the
    first kilobytes of one file are read, on the driver."""
    fs, p = _fs(spark, path)
    one = p if fs.getFileStatus(p).isFile() else next(s.getPath() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
    stream = fs.open(one)
    try:
        head = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(65536, fs.getFileStatus(one).getLen())))
    finally:
        stream.close()
    first = head.split(b"\n", 1)[0]
    for enc in ENCODINGS:
        try:
            line = first.decode(enc)
        except UnicodeDecodeError:
            continue
        for sep in SEPARATORS:
            if len(line.split(sep)) > least:
                return sep, enc
    raise ValueError(f"{path}: no separator gives more than {least} columns")


def read_export(spark: SparkSession, path: str, least: int = 5) -> DataFrame:
    """A CSV export with every column a string, trimmed header names and no byte-order mark."""
    sep, enc = probe_csv(spark, path, least)
    df = spark.read.csv(path, sep=sep, encoding="UTF-8" if enc.startswith("utf") else "ISO-8859-1", header=True, inferSchema=False, multiLine=True, escape='"')
    return df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines or CSV, by the ending of the path; a glob is its newest file."""
    if "*" in path:
        path = newest(spark, path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON-lines file, and its bad lines with the file they stand in. Blank lines are
    neither."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("file", F.input_file_name())
    st = T._parse_datatype_string(f"{schema}, _bad string")
    parsed = lines.withColumn("r", F.from_json("value", st, {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("r._bad is null").select("r.*").drop("_bad")
    return good, parsed.where("r._bad is not null").select("value", "file")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file, or the values of one JSON object keyed by id (a checkpoint),
    whichever the file is."""
    whole = spark.read.text(path, wholetext=True)
    st = T._parse_datatype_string(f"map<string,struct<{schema}>>")
    keyed = whole.select(F.from_json("value", st).alias("m")).where("m is not null")
    good, _ = read_json_lines(spark, path, schema)
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.from_json("value", "map<string,string>").isNotNull().alias("lines")).first()
    if first is not None and first["lines"] and good.limit(1).count() and good.where(F.coalesce(*[F.col(c).isNotNull() for c in good.columns[:1]])).limit(1).count():
        return good
    return keyed.select(F.explode(F.map_values("m")).alias("r")).select("r.*")


def read_tensor(spark: SparkSession, path: str, array: str, ids: str | None = None) -> DataFrame:
    """A three-dimensional array of an .npz archive as (example_id, layer, features)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                x = z[array]
                names = z[ids].astype(str) if ids else np.arange(len(x)).astype(str)
                for i, one in enumerate(x):
                    yield pd.DataFrame({"example_id": names[i], "layer": np.arange(len(one)), "features": list(one.astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "example_id string, layer long, features array<float>")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def fetch(df: DataFrame, url: str, get, most_bytes: int = 4_000_000, size=None) -> DataFrame:
    """``(url, kind, body, error)`` by a function ``get(url) -> (status, content_type, bytes)``:
    pdf or html bodies, or a code for what went wrong (empty_url, http_404, too_large, timeout,
    error). ``size(url)``, a HEAD request, tells the announced bytes (0 if unknown); what is a fifth
    beyond ``most_bytes`` is not asked for at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b["u"].tolist():
                if not (u or "").strip():
                    out.append((u, None, None, "empty_url"))
                    continue
                try:
                    if size and size(u) > 1.2 * most_bytes:
                        out.append((u, None, None, "too_large"))
                        continue
                    status, kind, body = get(u)
                    if status != 200:
                        out.append((u, None, None, f"http_{status}"))
                    elif len(body) > most_bytes:
                        out.append((u, None, None, "too_large"))
                    else:
                        out.append((u, "pdf" if "pdf" in kind.lower() or u.lower().endswith(".pdf") or body[:5] == b"%PDF-" else "html", body, None))
                except TimeoutError:
                    out.append((u, None, None, "timeout"))
                except Exception as e:
                    out.append((u, None, None, f"error:{type(e).__name__}"))
            yield pd.DataFrame(out, columns=["url", "kind", "body", "error"])

    return df.select(F.col(url).alias("u")).mapInPandas(run, "url string, kind string, body binary, error string")


def pdf_text(df: DataFrame, pages: int = 12, least: int = 50, extract=None, most_bytes: int = 4 << 20) -> DataFrame:
    """``(url, text, error)`` of PDF bodies of at most ``most_bytes``: the first pages joined by blank
    lines, if longer than ``least`` characters. ``extract(bytes, pages) -> list of page texts`` is any PDF library's; the
    one installed is used by default, and without any the error is no_pdf_library."""

    def default(data: bytes, n: int) -> list[str]:
        try:
            import pdfplumber
        except ImportError:
            raise ImportError("no_pdf_library") from None
        with pdfplumber.open(io.BytesIO(data)) as doc:
            return [p.extract_text() or "" for p in doc.pages[:n]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, data in zip(b["url"].tolist(), b["body"].tolist()):
                if len(data) > most_bytes:
                    out.append((u, None, "pdf_too_large"))
                    continue
                try:
                    text = "\n\n".join(t for t in (extract or default)(data, pages) if t.strip())
                    out.append((u, text, None) if len(text) > least else (u, None, "pdf_empty"))
                except ImportError as e:
                    out.append((u, None, str(e)))
                except Exception as e:
                    out.append((u, None, f"pdf_error:{type(e).__name__}"))
            yield pd.DataFrame(out, columns=["url", "text", "error"])

    return df.where("kind = 'pdf'").select("url", "body").mapInPandas(run, "url string, text string, error string")


def read_data_set(spark: SparkSession, source: str, config: str, split: str, resolve=None) -> DataFrame:
    """One split of one configuration of a published data set: a folder in the layout that
    ``sinks.publish`` writes, or a name that ``resolve(name)`` turns into such a folder. Splits may
    be folders of Parquet files or files called split-00000-of-00001.parquet."""
    folder = (resolve(source) if resolve else source).rstrip("/")
    fs, p = _fs(spark, f"{folder}/{config}/{split}")
    if fs.exists(p):
        return spark.read.parquet(f"{folder}/{config}/{split}")
    return spark.read.parquet(f"{folder}/{config}/{split}-*.parquet")
