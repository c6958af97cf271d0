"""Problem 7: noise in text from scanned pages, found and repaired.

Three facts about the whole corpus feed one map over its rows: the frequent words and compound
words (a vocabulary bounded by the share of all words that its members must have), the lines
that repeat within a document apart from digits and separators (running headers, counted by
hash), and the lines repeated across an issuer's documents (which are no headers). A row is
then read line by line: page numbers and headers are set apart, words cut at line ends are
joined if the vocabulary knows the whole, and words that the vocabulary does not know are
misread if undoing one of the usual confusions gives a far more frequent word.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, sized, written
from .lines import LineDropper, is_page_number, line_facts, repeated_of
from .textform import consistent

MIN_HEADER_ROWS = 3
LONGEST = 64  # letters of a word of the vocabulary; keeps what is broadcast bounded
OPTIONS = 256  # readings of a word beyond which they are looked for in the vocabulary letter by letter
WORD_SHARE, MIN_COUNT = 5e-7, 3  # at most two million words can have that share of all words
RARER = 8  # a misread form is at least so many times rarer than the word
DIGITAL = 0.1  # and at most this part of its places is in texts of one line, which are rarely scanned

# What recognition takes one or two letters for, as read and as printed.
CONFUSIONS = [
    ("c", "e"), ("l", "i"), ("i", "l"), ("0", "o"), ("f", "t"), ("t", "f"), ("ri", "n"), ("5", "s"), ("ii", "u"), ("1", "l"), ("1", "i"),
    ("6", "é"), ("6", "b"), ("6", "e"), ("rn", "m"), ("m", "rn"), ("l", "t"), ("9", "g"), ("cl", "d"), ("y", "v"), ("v", "y"), ("li", "h"),
    ("h", "li"), ("m", "in"), ("in", "m"), ("f", "s"), ("8", "b"), ("3", "e"), ("2", "z"), ("4", "a"), ("vv", "w"), ("nn", "m"), ("e", "c"),
    ("7", "t"), ("0", "ô"), ("c", "é"), ("u", "ii"), ("d", "cl"), ("tl", "d"), ("c", "o"), ("o", "c"),
]
# Letters read within numbers.
_NUMBER = re.compile(r"(?<![^\W_])(?=[\dOolISB]*\d)(?:\d+[OolISB]+\d*|[OolI]+\d{2,})(?![^\W_])")
MARKS = "-‐‑¬­"
_CUT = re.compile(rf"([^\W\d_]+(?:['’\-][^\W\d_]+)*)([{MARKS}])\s*$")
_HEAD = re.compile(r"\s*([^\W\d_]+)")
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_EDGE_NUMBER = re.compile(r"^\s*\d{1,4}(?:\s{2,}|\s*\|\s*)(?=\S)|(?<=\S)(?:\s{2,}|\s*\|\s*)\d{1,4}\s*$")
_ORDINAL = re.compile(r"^\d+(?:e|er|re|ère|ème|ième|nd|nde|th|st|rd)s?$")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def header_form(line: str) -> str:
    """A line without digits, blanks and separators, in lower case."""
    return _NOT_LETTERS.sub("", line.lower())


def _header_key(document: str, form: str) -> int:
    return xxhash.xxh64_intdigest(f"{document}\0{form}") - (1 << 63)


def vocabulary(df: DataFrame, column: str = "content", share: float = WORD_SHARE, least: int = MIN_COUNT) -> dict[str, tuple[int, int]]:
    """Counts of the words, and of the compounds with their hyphens, that make up at least
    ``share`` of all words of the corpus, ``least`` at the fewest: in all texts and in texts of
    one line. It has at most 1/share words of ``LONGEST`` letters, whatever the size of the corpus;
    they are collected as Arrow columns."""

    def frames(c: Counter[str], one: Counter[str]) -> Iterator[pd.DataFrame]:
        rows = [(w, n, one.get(w, 0)) for w, n in c.items()]
        for lo in range(0, len(rows), 5000):
            yield pd.DataFrame(rows[lo : lo + 5000], columns=["w", "n", "one"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, one = Counter[str](), Counter[str]()
        for b in batches:
            many = b[column].str.contains("\n", regex=False)
            for rows, to in ((b[column][many], c), (b[column][~many], one)):
                for lo in range(0, len(rows), 1000):
                    to.update(_TOKEN.findall("\n".join(rows.iloc[lo : lo + 1000].tolist()).lower()))
            if len(c) + len(one) > 1_000_000:
                yield from frames(c + one, one)
                c.clear(), one.clear()
        yield from frames(c + one, one)

    counts = df.select(column).where(F.col(column).isNotNull()).mapInPandas(count, "w string, n long, one long")
    counts = cut(counts.groupBy("w").agg(F.sum("n").alias("n"), F.sum("one").alias("one")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    got = counts.where((F.col("n") >= max(least, share * total)) & (F.length("w") <= LONGEST)).toArrow()
    return dict(zip(got["w"].to_pylist(), zip(got["n"].to_pylist(), got["one"].to_pylist())))


class Reader:
    """Reads one row: its noise, and its text as continuous paragraphs."""

    def __init__(self, vocab: dict[str, tuple[int, int]]):
        self.vocab, self.fixes, self.ordered = vocab, {}, None
        self.good = {w for w, (n, digital) in vocab.items() if digital > DIGITAL * n}

    def fix(self, word: str) -> str | None:
        """The word that a lower-case form was misread from, if it was."""
        if word not in self.fixes:
            if len(self.fixes) > 500_000:
                self.fixes.clear()
            self.fixes[word] = self._fix(word)
        return self.fixes[word]

    def _fix(self, word: str) -> str | None:
        if len(word) < 3 or word.isdigit() or _ORDINAL.match(word):
            return None
        own, digital = self.vocab.get(word, (0, 0))
        if digital > DIGITAL * own:
            return None
        options: set[str] = set()
        if any(c.isdigit() for c in word):
            per = [[b for a, b in CONFUSIONS if a == c] if c.isdigit() else [c] for c in word]
            if any(not p for p in per) or not any(c.isalpha() for c in word):
                return None
            options |= {"".join(p) for p in itertools.product(*per)} if math.prod(map(len, per)) <= OPTIONS else set(self._among(per))
        else:
            for a, b in CONFUSIONS:
                i = word.find(a)
                while i >= 0:
                    options.add(word[:i] + b + word[i + len(a) :])
                    i = word.find(a, i + 1)
        best = max(options, key=lambda w: (self.vocab.get(w, (0, 0)), w), default=None)
        if best is None or len(best) < 3:
            return None
        return best if self.vocab.get(best, (0, 0))[0] >= RARER * max(own, 1) else None

    def _among(self, per: list[list[str]]) -> list[str]:
        """The words of the vocabulary with one of the given letters at each place, by prefixes."""
        if self.ordered is None:
            self.ordered = sorted(self.vocab)
        heads = [""]
        for letters in per:
            longer = [h + x for h in heads for x in letters]
            at = [bisect.bisect_left(self.ordered, h) for h in longer]
            heads = [h for h, i in zip(longer, at) if i < len(self.ordered) and self.ordered[i].startswith(h)]
        return [h for h in heads if h in self.vocab]

    def whole(self, word: str) -> bool:
        return word in self.vocab or self.fix(word) is not None

    def cut_word(self, lines: list[str], aside: list[bool], i: int) -> tuple[int, str, str, bool] | None:
        """If a word is cut at the end of line i: the line of its rest, both parts, and whether
        the mark is only a cut; None if the line ends otherwise."""
        end = lines[i].rstrip()
        if aside[i] or end[-1:] not in MARKS or not end or not (m := _CUT.search(end)):
            return None
        head, mark = m.group(1), m.group(2)
        last = re.split(r"['’]", head)[-1]
        after = None
        for j in [j for j in range(i + 1, len(lines)) if lines[j].strip() and not aside[j]]:
            if not (t := _HEAD.match(lines[j])):
                continue
            tail = t.group(1)
            joined, compound, plain = (last + tail).lower(), f"{last}-{tail}".lower(), (last.rpartition("-")[2] + tail).lower()
            count = self.vocab.get(compound, (0, 0))[0]
            if count > self.vocab.get(joined, (0, 0))[0]:
                return j, head, tail, mark not in "-‐‑"
            if self.whole(joined) or (plain != joined and self.whole(plain)):
                return j, head, tail, True
            after = after or (j, head, tail, mark not in "-‐‑" or (not (last.lower() in self.vocab and tail.lower() in self.vocab) and "-" not in last and (tail[0].islower() or last.isupper() and tail.isupper())))
        return after

    def misread(self, text: str) -> bool:
        """Some word or number of the text was misread."""
        mixed = False
        for w in set(_TOKEN.findall(text.lower())) - self.good:
            for p in [w] if w in self.vocab else w.split("-"):
                if p.isdigit() or p in self.good:
                    continue
                if self.fix(p):
                    return True
                mixed = mixed or not p.isalpha()
        return mixed and _NUMBER.search(text) is not None

    def read(self, lines: list[str], headers: list[bool], repeated: list[bool], repair: bool = True) -> tuple[set[str], str]:
        """Kinds of noise and the text without headers and page numbers, with ``repair`` also with
        misread words put right; lines are in the consistent form."""
        kinds: set[str] = set()
        aside = [False] * len(lines)
        for i, line in enumerate(lines):
            if repeated[i]:
                aside[i] = True
            elif len(lines) > 1 and line.strip() and is_page_number(line.lower()):
                kinds.add("page")
                aside[i] = True
            elif headers[i]:
                kinds.add("header")
                if _EDGE_NUMBER.search(line):
                    kinds.add("page")
                aside[i] = True
        cuts: dict[int, tuple[int, str, str, bool]] = {}
        for i in range(len(lines)):
            if (c := self.cut_word(lines, aside, i)) is not None:
                cuts[i] = c
                if c[3]:
                    kinds.add("hyphenation")
        body = self._join(lines, aside, cuts)
        noise = "\n".join(x for i, x in enumerate(lines) if aside[i] and not repeated[i])
        if self.misread(body) or noise and self.misread(noise):
            kinds.add("misread")
        return kinds, self._repair(body) if repair and "misread" in kinds else body

    def _join(self, lines: list[str], aside: list[bool], cuts: dict[int, tuple[int, str, str, bool]]) -> str:
        """Body lines as paragraphs: a line goes on with the one before unless that ends a sentence."""
        out: list[str] = []
        glue = ""
        for i, line in enumerate(lines):
            if aside[i]:
                continue
            text = line.strip()
            if not text:
                glue = "\n\n"
                continue
            if i in cuts:
                text = _CUT.sub(lambda m, c=cuts[i]: m.group(1) + ("" if c[3] else "-"), text)
            if out:
                out.append(glue)
            out.append(text)
            ends = text[-1] in ".!?…:;»”" and not text.endswith(("réf.", "art.", "n°."))
            glue = "" if i in cuts else "\n" if ends else " "
        return "".join(out)

    def _repair(self, text: str) -> str:
        """The text with misread words and numbers put right, in the case of the word."""
        text = _NUMBER.sub(lambda m: m.group().translate(str.maketrans("OolISB", "001158")), text)

        def one(m: re.Match[str]) -> str:
            w = m.group()
            if "-" in w and w.lower() not in self.vocab:
                return "-".join(one(_TOKEN.match(x)) for x in w.split("-"))
            new = self.fix(w.lower())
            if new is None:
                return w
            letters = [c for c in w if c.isalpha()]
            if len(letters) > 1 and all(c.isupper() for c in letters):
                return new.upper()
            return new.capitalize() if w[0].isupper() else new

        return _TOKEN.sub(one, text)


def _header_mark(document: str, line: str) -> int | None:
    """The hash of a line that may be a header: more than a page number, and not the end of a sentence."""
    s = line.strip()
    if not s or s[-1] in ".!?;,:":
        return None
    form = header_form(s)
    return _header_key(document, form) if form and not is_page_number(s.lower()) else None


def _headers(facts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(row_id, headers)``: hashes of the lines of a row that repeat within their document and
    are no repeated lines of the issuer."""
    lines = facts.where("mark is not null").select("row_id", "line_no", F.col("mark").alias("header"))
    lines = cut(lines.join(repeated.select("row_id", F.col("line_no").cast("int").alias("line_no")), ["row_id", "line_no"], "left_anti").select("row_id", "header").distinct())
    keys = lines.groupBy("header").count().where(F.col("count") >= MIN_HEADER_ROWS).select("header")
    return lines.join(keys, "header", "left_semi").groupBy("row_id").agg(F.collect_set("header").alias("headers"))


def _pass(df: DataFrame, repaired: bool) -> DataFrame:
    facts, drop = written(line_facts(df, 1, _header_mark))
    repeated = cut(repeated_of(facts))
    dropper = LineDropper(repeated)
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(df))
    headers, _ = sized(_headers(facts, repeated), 200_000)
    drop()
    ready = dropper.prepare(df).join(headers, "row_id", "left")
    flags = dropper.flags

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(vocab.value)
        for b in batches:
            rows, out = [], []
            for row, doc, issuer, content, drop, own in zip(*[b[c].tolist() for c in ("row_id", "document_id", "emetteur", "content", "drop", "headers")]):
                if content is None:
                    if repaired:
                        rows.append(row), out.append(None)
                    continue
                lines = consistent(content).split("\n")
                gone = flags(issuer, lines, drop)
                have = set(own) if own is not None else ()
                heads = [bool(have) and _header_mark(doc, x) in have for x in lines]
                kinds, text = reader.read(lines, heads, gone, repaired)
                if repaired:
                    rows.append(row), out.append(text if kinds else content)
                else:
                    rows += [row] * len(kinds)
                    out += sorted(kinds)
            if rows:
                yield pd.DataFrame({"row_id": np.array(rows, dtype=np.int64), "v": pd.Series(out, dtype=object)})

    done = ready.select("row_id", "document_id", "emetteur", "content", "drop", "headers").where("row_id is not null").mapInPandas(run, "row_id long, v string")
    return done.withColumnRenamed("v", "content" if repaired else "kind")


def scan_noise(df: DataFrame) -> DataFrame:
    """``(row_id, kind)`` of each kind of noise in a row: hyphenation, misread, header or page.

    ``df`` has row_id, document_id, emetteur, content; other columns are ignored. Rows with null
    row_id or content have none; a row with null document_id has no headers; a text of one line
    is never a page number. Repeated rows come out once. An empty table gives no rows.
    """
    return _pass(df, False).distinct()


def repair(df: DataFrame) -> DataFrame:
    """``(row_id, content)``: rows with noise as continuous paragraphs in the consistent form,
    without headers, page numbers and repeated lines; other rows as they are."""
    return _pass(df, True)
