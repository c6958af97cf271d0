"""Writers: typed Parquet, CSV, JSON lines, run metadata, LaTeX tables, publication folders."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered(df: DataFrame, first: list[str], rest: bool = False) -> DataFrame:
    """The columns of ``first`` that exist, in that order; then the others if asked for."""
    have = [c for c in first if c in df.columns]
    return df.select(*have, *[c for c in df.columns if rest and c not in have])


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns in their types: simple types by a cast that gives null for what does not
    fit, arrays, maps and structs from their JSON."""
    out = {}
    for c, t in types.items():
        if c in df.columns:
            nested = t.lower().startswith(("array", "map", "struct"))
            out[c] = F.from_json(c, t) if nested else F.lower(F.trim(c)).isin("true", "1", "oui") if t == "boolean" else F.col(c).try_cast(t)
    return df.withColumns(out)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that have none."""
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "map", "struct"))})


def write_parquet(df: DataFrame, path: str, columns: list[str] | None = None, types: dict[str, str] | None = None) -> None:
    df = typed(df, types or {})
    (ordered(df, columns) if columns else df).write.mode("overwrite").option("compression", "snappy").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("append").csv(path, header=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """One table for people: a folder with one file; only for small results."""
    flat(df).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def publish(df: DataFrame, held_out: DataFrame, folder: str, dry_run: bool = True, card: str | None = None) -> dict[str, int]:
    """The two configurations of a data set, each with its split, and its card: rows by the path they
    go to. A dry run, the default, counts only and writes nothing."""
    parts = {f"{folder}/corpus/train": df, f"{folder}/gold/test": held_out}
    counts = {path: part.count() for path, part in parts.items()}
    if not dry_run:
        for path, part in parts.items():
            part.write.mode("overwrite").parquet(path)
        if card is not None:
            df.sparkSession.createDataFrame([(card,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/card")
    return counts


def write_confusions(df: DataFrame, folder: str, by: str = "model") -> None:
    """A confusion table as one CSV folder for each model."""
    flat(df).repartition(F.col(by)).write.mode("overwrite").partitionBy(by).csv(folder, header=True, escape='"')


def collect_artefacts(source: str, target: str, expected: dict[str, object], names: tuple[str, ...] = ("adapter_config.json", "adapter_model.safetensors", "tokenizer.json")) -> list[str]:
    """Copies the files of a trained model that exist under ``names`` into one folder. Its
    configuration, the first of them, must be there and agree with ``expected``, else nothing is
    copied."""
    config = Path(source, names[0])
    if not config.is_file():
        raise FileNotFoundError(str(config))
    held = json.loads(config.read_text(encoding="utf-8"))
    if wrong := {k: held.get(k) for k, v in expected.items() if held.get(k) != v}:
        raise ValueError(f"{config} differs from what is expected: {wrong}")
    Path(target).mkdir(parents=True, exist_ok=True)
    return [shutil.copy2(p, target) for p in (Path(source, n) for n in names) if p.is_file()]


#: Rows of a table that run metadata may hold.
META_ROWS = 10_000


def write_atomically(path: str, text: str) -> None:
    """A small file on the driver that is there whole or not at all."""
    folder = Path(path).resolve().parent
    fd, tmp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of the driver's on any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def run_metadata(path: str, source: str | None = None, parameters: dict | None = None, **tables: DataFrame) -> dict:
    """Parameters, the hash of a source file, and small aggregates, as one JSON document.
    An aggregate of more than ``META_ROWS`` rows is an error, and nothing is written."""
    meta = metadata(parameters, **tables)
    if source and os.path.isfile(source):
        with open(source, "rb") as f:
            meta["source_sha256"] = hashlib.file_digest(f, "sha256").hexdigest()
    write_atomically(path, json.dumps(meta, ensure_ascii=False, indent=1, default=str))
    return meta


def metadata(parameters: dict | None = None, **tables: DataFrame) -> dict:
    """Parameters and small aggregates of a run."""
    meta: dict = {"parameters": parameters or {}}
    for name, df in tables.items():
        rows = df.limit(META_ROWS + 1).collect()
        if len(rows) > META_ROWS:
            raise ValueError(f"{name} has more than {META_ROWS} rows; write it as a table")
        meta[name] = [r.asDict(recursive=True) for r in rows]
    return meta


def latex_table(df: DataFrame, columns: list[str], caption: str, label: str, places: int = 3) -> str:
    """A LaTeX table of a small result; null is a dash."""
    mark = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}

    def cell(v) -> str:
        if v is None:
            return "--"
        s = f"{v:.{places}f}" if isinstance(v, float) else str(v)
        return "".join(mark.get(c, c) for c in s)

    kinds = dict(df.dtypes)
    align = "".join("l" if kinds[c] == "string" else "r" for c in columns)
    lines = [" & ".join(cell(v) for v in row) + r" \\" for row in df.select(*columns).collect()]
    head = " & ".join(cell(c) for c in columns) + r" \\"
    return "\n".join([r"\begin{table}[t]", r"\centering", rf"\begin{{tabular}}{{{align}}}", r"\toprule", head, r"\midrule", *lines, r"\bottomrule", r"\end{tabular}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{table}"])


def report_tables(suite: DataFrame, by_epoch: DataFrame, confusion: DataFrame, pairs: DataFrame, agreement: DataFrame, shares: DataFrame) -> dict[str, str]:
    """The six tables of a report: figures by model, by period, confusion, tests between models,
    agreement of annotators, and shares of labels."""
    given = {"models": (suite, "Figures by model"), "epochs": (by_epoch, "Figures by period"), "confusion": (confusion, "Gold by predicted"), "tests": (pairs, "Tests between models"), "agreement": (agreement, "Agreement by variable"), "labels": (shares, "Shares of labels")}
    return {name: latex_table(df, df.columns, caption, f"tab:{name}") for name, (df, caption) in given.items()}
