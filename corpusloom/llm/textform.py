"""Problem 3: one consistent form for text that looks the same but differs in its characters.

Look-alike relations between code points and short strings (full-width forms, ligatures,
composed and separate accents, spaces, invisible characters, letters of other scripts) are
closed transitively by union-find. Each class gets a representative: of its members in plain
form the one most frequent in the corpus, ties to the shortest and lowest. A multi-pattern
automaton then rewrites text greedily, longest match first, until nothing changes. Letters of
another script are rewritten only inside a word that holds a Latin letter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter.
LOOKALIKE_LETTERS = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "D": "Ꭰ", "E": "ΕЕ", "F": "Ϝ", "G": "Ԍ", "H": "ΗН", "I": "ΙІӀ", "J": "Ј",
    "K": "ΚК", "L": "Ꮮ", "M": "ΜМ", "N": "Ν", "O": "ΟОՕ", "P": "ΡР", "Q": "Ԛ", "S": "ЅՏ", "T": "ΤТ", "V": "Ѵ",
    "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ց", "h": "һ", "i": "іι", "j": "јϳ", "k": "κк", "l": "ӏ",
    "n": "ո", "o": "οоօ", "p": "ρр", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγ",
}
INVISIBLE = "\u00AD\u180E\u200B\u200C\u200D\u200E\u200F\u2060\u2061\u2062\u2063\u2064\uFEFF"
SPACES = "\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
LIGATURES = "\uFB00\uFB01\uFB02\uFB03\uFB04"
MARKS = "\u0300-\u036F\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF"
FULL_WIDTH = "\uFF01-\uFF60\uFFE0-\uFFE6"
#: Letters of no Latin script and no common use, in the syntax of Java and of the regex module.
FOREIGN_JAVA = r"[\p{L}&&[^\p{IsLatin}\p{IsCommon}]]"

#: Text of these characters only is in the consistent form already; one class, common ranges first.
SUSPECT_JAVA = r"[^\x00-\x9F\u00A1-\u00AC\u00AE-\u024F\u2010-\u2027\u2030-\u205E\u2070-\u20CF\u2100-\u214F\u2190-\u27BF]"
_FOREIGN = "\u0370-\u03FF\u0400-\u052F\u0530-\u058F\u0590-\u10FF\u1100-\u1CFF\u1F00-\u1FFF\u2C00-\u2C5F\u2C80-\u2DFF\u3040-\uA71F\uA800-\uAB2F\uAB65-\uFAFF\uFB13-\uFDFF\uFE70-\uFEFC\uFF66-\uFFDC"
SUSPECT = re.compile(f"[{FULL_WIDTH}{MARKS}{INVISIBLE}{SPACES}{LIGATURES}{_FOREIGN}]")
FOREIGN = re.compile(f"[{_FOREIGN}]")
_IN_WORD = re.compile(rf"[^\W\d_]|[{MARKS}{INVISIBLE}]")
_LATIN = re.compile("[A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿﬀ-ﬆＡ-Ｚａ-ｚ]")
_OTHER = regex.compile(r"[\p{L}--\p{Latin}--\p{Common}]", regex.V1)
#: What stays a case after rewriting, as it has no look-alike in plain form.
_LEFT = re.compile(rf"[{FULL_WIDTH}{MARKS}{INVISIBLE}{SPACES}{LIGATURES}]")

WORD = re.compile(r"[^\W_]+")


def relations() -> Iterator[tuple[str, str]]:
    """Pairs of strings that look alike, by rule except for the letters listed above."""
    for latin, others in LOOKALIKE_LETTERS.items():
        for o in others:
            yield latin, o
    for c in INVISIBLE:
        yield "", c
    for c in SPACES:
        yield " ", c
    for c in LIGATURES:
        yield unicodedata.normalize("NFKC", c), c
    for a, b in ((0xFF01, 0xFF5E), (0xFFE0, 0xFFE6)):
        for n in range(a, b + 1):
            if len(plain := unicodedata.normalize("NFKC", chr(n)).strip()) == 1:
                yield plain, chr(n)
    for n in range(0xC0, 0x1F00):
        d = unicodedata.decomposition(chr(n))
        if d and d[0] != "<" and len(parts := d.split()) == 2 and unicodedata.combining(chr(int(parts[1], 16))):
            yield chr(n), "".join(chr(int(p, 16)) for p in parts)


def _plain(s: str) -> bool:
    return not _LEFT.search(s) and not _OTHER.search(s)


class LookalikeTable:
    """Classes of look-alike strings and the representative that each of their members becomes."""

    def __init__(self, counts: dict[str, int] | None = None):
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in relations():
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[rb] = ra
        self.classes: dict[str, list[str]] = {}
        for x in sorted(parent):
            self.classes.setdefault(find(x), []).append(x)
        counts = counts or {}
        self.rewrite: dict[str, str] = {}
        for members in self.classes.values():
            if plain := [m for m in members if _plain(m)]:
                rep = min(plain, key=lambda m: (-counts.get(m, 0), len(m), m))
                self.rewrite |= {m: rep for m in members if m != rep and not _plain(m)}
        self.foreign = {m for m in self.rewrite if _OTHER.search(m)}

    def members(self) -> list[str]:
        return sorted({m for ms in self.classes.values() for m in ms if m})


class Rewriter:
    """``rewriter(text)`` is the consistent form of text. Kept per worker process and table."""

    def __init__(self, table: LookalikeTable | None = None):
        self.table = table or LookalikeTable()
        self.auto = ahocorasick.Automaton()
        for k, v in self.table.rewrite.items():
            self.auto.add_word(k, (k, v))
        self.auto.make_automaton()

    def _latin_words(self, text: str) -> list[tuple[int, int]]:
        """Spans of the words that hold a letter of another script beside a Latin letter."""
        spans, at = [], 0
        for m in FOREIGN.finditer(text):
            if m.start() < at:
                continue
            i, j = m.span()
            while i and _IN_WORD.match(text[i - 1]):
                i -= 1
            while j < len(text) and _IN_WORD.match(text[j]):
                j += 1
            at = j
            if j - i > 1 and _LATIN.search(text, i, j):
                spans.append((i, j))
        return spans

    def _once(self, text: str) -> str:
        latin = self._latin_words(text)
        out, at, k = [], 0, 0
        for end, (old, new) in self.auto.iter_long(text):
            start = end - len(old) + 1
            if old in self.table.foreign:
                while k < len(latin) and latin[k][1] <= start:
                    k += 1
                if k == len(latin) or latin[k][0] > start:
                    continue
            out += [text[at:start], new]
            at = end + 1
        return "".join([*out, text[at:]]) if out else text

    def __call__(self, text: str) -> str:
        if not SUSPECT.search(text):
            return text
        if not _LEFT.search(text) and not self._latin_words(text):
            return text
        before = None
        while text != before and SUSPECT.search(text):  # every rewriting leaves fewer suspects or a shorter text
            text, before = self._once(text), text
        return unicodedata.normalize("NFC", text) if re.search(f"[{MARKS}]", text) else text


_DEFAULT: Rewriter | None = None


def consistent(text: str) -> str:
    """The consistent form under the table without counts; built once per worker process."""
    global _DEFAULT
    if _DEFAULT is None:
        _DEFAULT = Rewriter()
    return _DEFAULT(text)


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case, in the consistent form."""
    return WORD.findall(consistent(text).lower())


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, dtype=np.uint64))
_TABLES: dict[str, np.ndarray] = {}


def spans(sizes: Iterable[int], rows: int = 2000, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows, each with at most so many rows and, unless one row alone has more, characters,
    so that arrays by character stay small however long the texts are."""
    lo = total = end = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo >= rows or total + n > chars):
            yield lo, i
            lo, total = i, 0
        total, end = total + n, i + 1
    if end > lo:
        yield lo, end


def by_size(batches: Iterable[pa.RecordBatch], column: str, rows: int = 2000, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches by ``spans`` of a text column."""
    for b in batches:
        if b.num_rows:
            sizes = pc.fill_null(pc.utf8_length(b.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in spans(sizes, rows, chars):
                yield b.slice(lo, hi - lo)


def code_table(name: str, test: Callable[[str], bool]) -> np.ndarray:
    """For each code point whether ``test`` holds; built once per worker process."""
    if name not in _TABLES:
        _TABLES[name] = np.fromiter((test(chr(c)) for c in range(0x110000)), dtype=bool, count=0x110000)
    return _TABLES[name]


def token_hashes(texts: list[str], within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of characters of a class, text by text: the hashes in order, how
    many each text has, and the first code point of each run. Whole batches at once."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = within[codes]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    ends = np.cumsum(sizes)
    firsts = (ends - sizes)[sizes > 0]
    start[firsts] = inside[firsts]
    at = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(at, np.r_[0, ends]))
    if not len(at):
        return np.zeros(0, dtype=np.uint64), counts, codes[:0]
    chars = np.flatnonzero(inside)
    first = np.searchsorted(chars, at)
    lens = np.diff(np.r_[first, len(chars)])
    place = np.arange(len(chars)) - np.repeat(first, lens)
    h = np.add.reduceat((codes[chars].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095], first)
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h * _M1 | np.uint64(1), counts, codes[at]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that are in the consistent form and in lower case, and how many
    each text has."""
    return token_hashes(texts, code_table("word", str.isalnum))[:2]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _key(member: str) -> int:
    k = 0
    for c in member:
        k = k << 21 | ord(c)
    return k


def fit(df: DataFrame, columns: Iterable[str]) -> LookalikeTable:
    """Count every member of every class in all values of ``columns`` and choose representatives.

    Counting is one vectorised pass with a partial count per partition; what reaches the driver
    has at most one row per member of the table, whatever the size of the corpus.
    """
    members = LookalikeTable().members()
    by_len = {n: np.array(sorted(_key(m) for m in members if len(m) == n), dtype=np.uint64) for n in (1, 2, 3)}
    names = {_key(m): m for m in members}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(k), dtype=np.int64) for n, k in by_len.items()}
        for b in by_size(batches, "v", 10_000):
            text = "\n".join(b.column("v").to_pylist())
            one = _codes(text)
            grams = {1: one, 2: one[:-1] << np.uint64(21) | one[1:], 3: (one[:-2] << np.uint64(42)) | (one[1:-1] << np.uint64(21)) | one[2:]}
            for n, keys in by_len.items():
                if len(grams[n]) and len(keys):
                    if n > 1:  # only where the last character is one that some member ends on
                        grams[n] = grams[n][np.isin(grams[n] & np.uint64(0x1FFFFF), np.unique(keys & np.uint64(0x1FFFFF)))]
                        pos = np.minimum(np.searchsorted(keys, grams[n]), len(keys) - 1)
                        np.add.at(total[n], pos[keys[pos] == grams[n]], 1)
                    else:
                        c = np.bincount(grams[1].astype(np.int64), minlength=0x110000)
                        total[1] += c[keys.astype(np.int64)]
        k, v = np.concatenate(list(by_len.values())), np.concatenate(list(total.values()))
        yield pa.RecordBatch.from_pydict({"k": k[v > 0].astype(np.int64), "n": v[v > 0]})

    values = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("v")).where("v is not null")
    rows = values.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return LookalikeTable({names[r["k"]]: r["n"] for r in rows})


def consistent_udf(table: LookalikeTable | None = None):
    """A pandas UDF for the consistent form of a column; use it through ``consistent_col``."""
    state: dict[str, Rewriter] = {}

    @F.pandas_udf(T.StringType())
    def f(s: pd.Series) -> pd.Series:
        if "r" not in state:
            state["r"] = Rewriter(table)
        return s.map(lambda x: None if x is None else state["r"](x))

    return f


def consistent_col(c: Column, table: LookalikeTable | None = None) -> Column:
    """The consistent form; values without a suspect character never leave the JVM."""
    return F.coalesce(consistent_udf(table)(F.when(c.rlike(SUSPECT_JAVA), c)), c)


def normalise(df: DataFrame, columns: Iterable[str], table: LookalikeTable | None = None) -> DataFrame:
    """``df`` with the named columns in the consistent form. Null stays null, empty stays empty."""
    return df.withColumns({c: consistent_col(F.col(c), table) for c in columns})


def findings(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """One row ``(key, field)`` for each value that the rewriting changes, or that holds a mark,
    form or letter for which no plain look-alike exists. Null and empty values are no cases.
    """
    columns = list(columns)
    rewrite = consistent_udf(fit(df, columns))
    v = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in columns])).alias("x"))
    v = v.select(key, "x.field", "x.v").where(F.col("v").rlike(SUSPECT_JAVA))
    left = rf"[{FULL_WIDTH}{MARKS}{INVISIBLE}{SPACES}{LIGATURES}]|\p{{IsLatin}}{FOREIGN_JAVA}|{FOREIGN_JAVA}\p{{IsLatin}}"
    v = v.withColumn("form", rewrite("v"))
    return v.where((F.col("form") != F.col("v")) | F.col("form").rlike(left)).select(key, "field").distinct()

