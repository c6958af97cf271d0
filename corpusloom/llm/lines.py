"""Problem 4: lines that recur across the documents of one source.

Lines are brought to the consistent form, lower case and single blanks; numbers, dates and the
issuer's name are masked; minhash bands over the masked words cluster near-equal lines within
each issuer. Only lines in a cluster of high document frequency go on to the exact count, so
the expensive distinct count sees a few lines of the corpus. Equal lines share all bands, so
no repeated line is lost.

One pass over the corpus emits hashes only, never text; bucket counts are combined before the
shuffle, and what is counted exactly is spread by line and document, so an issuer or a line
with a third of all rows is no single task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, sized, written
from .textform import WORD, by_size, code_table, consistent, token_hashes

MIN_DOCUMENTS = 5
SHINGLE, BANDS, ROWS = 5, 3, 2  # a similarity of 0.8 meets in a band with 0.95; equal lines need one band

# Month names, masked as parts of dates.
MONTHS = set(
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre "
    "january february march april may june july august september october november december".split()
)
# Words after which a line cannot end a sentence.
OPEN_WORDS = set(
    "le la les l un une des de du d à au aux en et ou par pour sur dans avec sans sous que qui dit voir n "
    "the a an of to and or by for on in with at from that which".split()
)
_PAGE = re.compile(r"^[\W_]*(?:p(?:age|\.)?\s*)?\d{1,4}(?:\s*(?:/|sur|of|de)\s*\d{1,4})?[\W_]*$")
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def same_form(line: str) -> str:
    """What equal lines have in common: lower case, no outer blanks, single inner blanks.
    The text is already in the consistent form."""
    return " ".join(line.split()).lower()


def line_key(issuer: str, line: str) -> int:
    """64 bits of an issuer and a line in the form of ``same_form``, as a signed integer."""
    return xxhash.xxh64_intdigest(f"{issuer}\0{line}") - (1 << 63)


def is_page_number(line: str) -> bool:
    return bool(_PAGE.match(line))


def _open_end(s: str) -> bool:
    return s[-1] not in ".!?…:;»)”\"" or s.endswith("n°")


def _goes_on(a: str, b: str) -> bool:
    """Line b goes on with the sentence of line a."""
    a, b = a.strip(), b.strip()
    if not a or not b or not _open_end(a):
        return False
    if b.lstrip("«(\"'“ ")[:1].islower() or a[-1] in ",(«-–¬'’":
        return True
    last = WORD.findall(a[-20:].lower())
    return bool(last) and last[-1] in OPEN_WORDS


def _bands(forms: list[str], bands: int) -> np.ndarray:
    """Minhash bands of the word shingles of each line, ``len(forms) x bands``. Words are what stands
    between blanks; all numbers are one word, and so are all parts of dates."""
    not_blank = code_table("not blank", lambda c: c != " ")
    flat, lens, first = token_hashes(forms, not_blank)
    flat = np.where(code_table("digit", str.isdigit)[first], np.uint64(1), flat)
    flat[np.isin(flat, token_hashes(sorted(MONTHS), not_blank)[0])] = np.uint64(3)
    pad = np.concatenate([flat, np.zeros(SHINGLE, dtype=np.uint64)])
    ends = np.repeat(np.cumsum(lens), lens)
    at = np.arange(len(flat))
    h = np.zeros(len(flat), dtype=np.uint64)
    for k in range(SHINGLE):  # a shingle at the end of a line is shorter; one at its start is always whole
        h = (h ^ np.where(at + k < ends, pad[k : len(flat) + k], np.uint64(0))) * _MIX[1]
        h ^= h >> np.uint64(29)
    first = at - np.repeat(np.cumsum(lens) - lens, lens)
    keep = (first == 0) | (at + SHINGLE <= ends)
    h, owner = h[keep], np.repeat(np.arange(len(lens)), lens)[keep]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out = np.empty((len(lens), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(lens), b + 1, dtype=np.uint64)
        for r in range(ROWS):
            x = h * _MIX[2 * b + r]
            x ^= x >> np.uint64(32)
            key = (key ^ np.minimum.reduceat(x * _MIX[(2 * b + r + 1) % 6], starts)) * _MIX[3]
        out[:, b] = key ^ (key >> np.uint64(31))
    return out


def line_facts(df: DataFrame, bands: int = BANDS, mark: Callable[[str, str], int | None] | None = None) -> DataFrame:
    """Hashes of each line that can count: not blank, of a known issuer, no page number.

    ``mark(document_id, line)`` may name a further hash of a line, in the column ``mark``; lines
    that have one come out even if the issuer is null (with a null key).
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        issuers: dict[str | None, tuple[str, str, int]] = {None: ("", "", 0)}
        for batch in by_size(batches, "content"):
            rows, nos, keys, docs, pieces, masked, salts, marks = [], [], [], [], [], [], [], []
            for row, doc, issuer, content in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if (known := issuers.get(issuer)) is None:
                    form = consistent(issuer)
                    known = issuers[issuer] = (form, same_form(form), xxhash.xxh64_intdigest(form))
                own, name, salt = known
                lines = consistent(content).split("\n")
                doc_hash = None if doc is None else xxhash.xxh64_intdigest(doc) - (1 << 63)
                goes_on = [_goes_on(a, b) for a, b in zip(lines, lines[1:])] if len(lines) > 1 else []
                for i, line in enumerate(lines):
                    form = same_form(line)
                    if not form or len(form) < 40 and _PAGE.match(form):
                        continue
                    own_mark = mark(doc, line) if mark and doc is not None else None
                    if issuer is None and own_mark is None:
                        continue
                    rows.append(row), nos.append(i + 1), docs.append(doc_hash), salts.append(salt), marks.append(own_mark)
                    keys.append(None if issuer is None else line_key(own, form))
                    pieces.append((i > 0 and goes_on[i - 1]) or (i < len(goes_on) and goes_on[i]))
                    masked.append(form.replace(name, "N") if name and name in form else form)
            if rows:
                ids = (_bands(masked, bands) ^ np.array(salts, dtype=np.uint64)[:, None]).view(np.int64)
                cols = {"row_id": pa.array(rows, pa.int64()), "line_no": pa.array(nos, pa.int32()), "key": pa.array(keys, pa.int64()), "doc": pa.array(docs, pa.int64()), "piece": pa.array(pieces, pa.bool_())}
                cols |= {f"b{b}": pa.array(np.ascontiguousarray(ids[:, b])) for b in range(bands)} | ({"mark": pa.array(marks, pa.int64())} if mark else {})
                yield pa.RecordBatch.from_pydict(cols)

    known = "row_id is not null and content is not null" + ("" if mark else " and emetteur is not null")
    schema = "row_id long, line_no int, key long, doc long, piece boolean, " + ", ".join(f"b{b} long" for b in range(bands)) + ", mark long" * bool(mark)
    return df.select("row_id", "document_id", "emetteur", "content").where(known).mapInArrow(facts, schema)


def _by_bucket(facts: DataFrame) -> DataFrame:
    bands = [c for c in facts.columns if re.fullmatch(r"b\d", c)]
    if len(bands) == 1:
        return facts.withColumnRenamed(bands[0], "b")
    return facts.select("row_id", "line_no", "key", "doc", "piece", F.explode(F.array(*bands)).alias("b"))


def repeated_lines(df: DataFrame, min_documents: int = MIN_DOCUMENTS, exact: bool = True, bands: int = BANDS) -> DataFrame:
    """``(row_id, line_no, key)`` of each line repeated in ``min_documents`` documents of its issuer.

    ``df`` has row_id, document_id, emetteur, content; other columns are ignored. With ``exact``
    the line itself must be that frequent, else its cluster of near-equal lines; equal lines share
    every band, so one of the ``bands`` is enough for the former. A line that in
    most of its places is a piece of a longer sentence is left out. Rows with null issuer or
    content neither count nor come out; a null document_id counts for no document; rows taken
    in twice come out for each line_no once. An empty table gives no rows.
    """
    facts, drop = written(line_facts(df, bands))
    lines = repeated_of(facts, min_documents, exact)
    drop()
    return lines


def repeated_of(facts: DataFrame, min_documents: int = MIN_DOCUMENTS, exact: bool = True) -> DataFrame:
    """``repeated_lines`` of line facts that are materialised already; what comes out needs them
    no more."""
    every = _by_bucket(facts.where("key is not null"))
    heavy, _ = sized(every.groupBy("b").count().where(F.col("count") >= min_documents).select("b"))
    facts = cut(every.join(heavy, "b", "left_semi"))
    frequent = facts.groupBy("b").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= min_documents).select("b")
    lines = facts.join(frequent, "b", "left_semi").select("row_id", "line_no", "key", "doc", "piece").distinct()
    keys = lines.groupBy("key").agg(F.count_distinct("doc").alias("n"), F.avg(F.col("piece").cast("double")).alias("share"))
    keys = keys.where((F.col("share") < 0.5) & (F.lit(not exact) | (F.col("n") >= min_documents))).select("key")
    return lines.join(keys, "key", "left_semi").select("row_id", F.col("line_no").cast("long").alias("line_no"), "key").distinct()


class LineFlags:
    """Tells the repeated lines of a text; this part of ``LineDropper`` goes to the workers."""

    def __init__(self, held):
        self.held, self.forms = held, {}

    def __call__(self, issuer: str | None, lines: list[str], drop) -> list[bool]:
        """Flags for lines in the consistent form; ``drop`` is the column of ``prepare``."""
        if self.held is None:
            own = set() if drop is None else set(drop)
            return [i + 1 in own for i in range(len(lines))]
        if issuer is None:
            return [False] * len(lines)
        if issuer not in self.forms:
            self.forms[issuer] = consistent(issuer)
        known, own = self.held.value, self.forms[issuer]
        return [bool(form := same_form(x)) and line_key(own, form) in known for x in lines]


class LineDropper:
    """Takes repeated lines out of texts inside a Python pass.

    Up to ``runtime.BROADCAST_ROWS`` distinct lines go to the workers as a set of hashes; beyond that
    each row gets the numbers of its own lines by a join.
    """

    def __init__(self, lines: DataFrame):
        self.lines = lines
        keys, self.small = sized(lines.select("key").distinct())
        sc = lines.sparkSession.sparkContext
        self.flags = LineFlags(sc.broadcast(frozenset(keys.toPandas()["key"].tolist())) if self.small else None)

    def prepare(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``drop``: line numbers, or null where hashes do."""
        if self.small:
            return df.withColumn("drop", F.lit(None).cast("array<long>"))
        per_row = self.lines.groupBy("row_id").agg(F.collect_set("line_no").alias("drop"))
        return df.join(per_row, "row_id", "left")


def without_repeated_lines(df: DataFrame, lines: DataFrame) -> DataFrame:
    """``(row_id, content)`` with the repeated lines taken out; other lines stay as they are.
    Null content stays null; content of which nothing stays is the empty string."""
    dropper = LineDropper(lines)
    flags = dropper.flags

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for issuer, content, drop in zip(b["emetteur"].tolist(), b["content"].tolist(), b["drop"].tolist()):
                if content is not None:
                    raw = content.split("\n")
                    content = "\n".join(x for x, f in zip(raw, flags(issuer, [consistent(x) for x in raw], drop)) if not f)
                out.append(content)
            yield pd.DataFrame({"row_id": b["row_id"], "content": out})

    return dropper.prepare(df.select("row_id", "emetteur", "content").where("row_id is not null")).mapInPandas(clean, "row_id long, content string")
