"""Workbooks: a reader of .xlsx sheets, and a writer with drop-down lists that depend on each other.

The format is zipped XML, so neither needs a library beyond Python's own.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.taxonomy import CATEGORIES, HORIZONS, SUBCODES, SURPRISE

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet (the first by default) as strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): links[s.get(_REL)] for s in book.find("m:sheets", _NS)}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet} among {', '.join(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        tree = ET.fromstring(z.read(f"xl/{target.lstrip('/').removeprefix('xl/')}"))
    for row in tree.find("m:sheetData", _NS):
        out: list[str | None] = []
        for i, c in enumerate(row):
            at = _column(c.get("r")) if c.get("r") else i
            out += [None] * (at + 1 - len(out))
            v, kind = c.find("m:v", _NS), c.get("t")
            if kind == "inlineStr":
                out[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif v is not None:
                out[at] = shared[int(v.text)] if kind == "s" else v.text
        yield out


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet with all columns as strings, named by the first row. The file is read by Spark, so
    it may be on any file system that Spark knows; several files need one header."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                row = next(read_sheet(data, sheet), [])
                yield pd.DataFrame({"name": [n for n in ((x or "").strip() for x in row) if n]})

    names = list(dict.fromkeys(r["name"] for r in files.limit(1).mapInPandas(heads, "name string").collect()))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                got = read_sheet(data, sheet)
                head = [(x or "").strip() for x in next(got, [])]
                at = [head.index(n) for n in names]
                yield pd.DataFrame([[r[i] if i < len(r) else None for i in at] for r in got], columns=names, dtype=object)

    return files.mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))


def _letters(n: int) -> str:
    return (_letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def _cell(ref: str, v) -> str:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f'<c r="{ref}"><v>{v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def _grid(rows: list[list]) -> str:
    lines = ("".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(r) if v is not None) for i, r in enumerate(rows, 1))
    return "<sheetData>" + "".join(f'<row r="{i}">{x}</row>' for i, x in enumerate(lines, 1)) + "</sheetData>"


def write_workbook(path: str | io.BytesIO, sheets: dict[str, tuple[list[str], list[list]]], choices: dict[tuple[str, str], list[str]] | None = None, cascades: dict[tuple[str, str], tuple[str, dict[str, list[str]]]] | None = None, hidden: tuple[str, ...] = ()) -> None:
    """Small tables for people to fill in: ``{sheet: (header, rows)}``, with drop-down lists for the
    columns in ``choices`` {(sheet, column): values}. A column in ``cascades`` {(sheet, column):
    (other column, {value: values})} offers the values that belong to what the other column of its
    row holds, by named ranges. All lists are on a sheet of their own that is hidden, as are those
    in ``hidden``."""
    lists: list[list[str]] = []
    named: dict[str, str] = {}

    def held(values: list[str]) -> str:
        lists.append(values)
        c = _letters(len(lists) - 1)
        return f"Listes!${c}$1:${c}${len(values)}"

    bodies: dict[str, str] = {}
    for name, (header, rows) in sheets.items():
        rules = []

        def rule(column: str, formula: str, header=header, rows=rows, rules=rules) -> None:
            c = _letters(header.index(column))
            rules.append(f'<dataValidation type="list" allowBlank="1" sqref="{c}2:{c}{len(rows) + 1}"><formula1>{escape(formula)}</formula1></dataValidation>')

        for (s, column), values in (choices or {}).items():
            if s == name:
                rule(column, held(values))
        for (s, column), (other, by) in (cascades or {}).items():
            if s == name:
                named |= {f"{column}_{value}": held(values) for value, values in by.items() if values}
                rule(column, f'INDIRECT("{column}_"&{_letters(header.index(other))}2)')
        bodies[name] = _grid([header, *rows]) + (f'<dataValidations count="{len(rules)}">{"".join(rules)}</dataValidations>' if rules else "")
    if lists:
        bodies["Listes"] = _grid([[v[i] if i < len(v) else None for v in lists] for i in range(max(map(len, lists)))])
        hidden = (*hidden, "Listes")
    main, rel = _NS["m"], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = [f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(bodies) + 1)]
    tabs = [f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"{" state=" + chr(34) + "hidden" + chr(34) if n in hidden else ""}/>' for i, n in enumerate(bodies, 1)]
    links = [f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(bodies) + 1)]
    names = "".join(f'<definedName name="{escape(n)}">{ref}</definedName>' for n, ref in named.items())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{"".join(parts)}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(tabs)}</sheets>{f"<definedNames>{names}</definedNames>" if names else ""}</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{package}/relationships">{"".join(links)}</Relationships>')
        for i, body in enumerate(bodies.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><worksheet xmlns="{main}">{body}</worksheet>')


#: Rows of a workbook for annotators; what is beyond is an error.
MOST_ROWS = 100_000
GIVEN = ["row_id", "epoch", "doc_group", "iaa_subset", "content"]
TO_FILL = ["csrd_category", "esrs_subcategory", "materialite_score", "materialite_financiere", "materialite_impact", "market_surprise", "horizon_temporel", "chain_of_thought", "confiance_annotation", "notes"]


def annotation_workbook(path: str, rows: DataFrame, strata: DataFrame) -> None:
    """The workbook of an annotation round: seven sheets. ``rows`` has the columns ``GIVEN``; what
    they were drawn by (``strata``: row_id, stratum, density) stays on a hidden sheet, so that it
    does not sway anyone. Subcategories offered depend on the category chosen."""
    got = rows.select(*[F.col(c).cast("string") for c in GIVEN]).orderBy(F.col("row_id").cast("long")).limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows for one workbook")
    drawn = strata.join(F.broadcast(rows.select("row_id")), "row_id").select("row_id", "stratum", "density").orderBy("row_id").limit(MOST_ROWS).collect()
    sizes = strata.join(F.broadcast(rows.select("row_id")), "row_id").groupBy("stratum").agg(F.count("*").alias("n")).orderBy("stratum").collect()
    sheets = {
        "Instructions": (["Instructions"], [["Remplir les colonnes à droite de l'extrait."], ["Sans pertinence : none, score 0, Non et Non, horizon vide."], ["Raisonnement en deux ou trois phrases ; confiance de 0 à 1."]]),
        "Taxonomie": (["code", "pilier", "libellé", "sous-codes"], [[c, p, lab, ", ".join(SUBCODES[c])] for c, p, lab in CATEGORIES]),
        "Echelle": (["score", "sens"], [[0, "none"], [1, "négligeable"], [5, "critique"]]),
        "Annotation": ([*GIVEN, *TO_FILL], [[*r, *[None] * len(TO_FILL)] for r in got]),
        "Metadonnees": (["row_id", "stratum", "density"], [list(r) for r in drawn]),
        "Resume": (["stratum", "n"], [list(r) for r in sizes]),
    }
    yes = ["Oui", "Non"]
    lists = {"csrd_category": [c for c, _, _ in CATEGORIES], "materialite_score": [str(i) for i in range(6)], "materialite_financiere": yes, "materialite_impact": yes, "market_surprise": SURPRISE, "horizon_temporel": HORIZONS}
    subs = {c: v for c, v in SUBCODES.items() if c != "none"}
    write_workbook(path, sheets, {("Annotation", c): v for c, v in lists.items()}, {("Annotation", "esrs_subcategory"): ("csrd_category", subs)}, ("Metadonnees",))
