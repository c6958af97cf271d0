"""Problem 8: the corpus as token ids of a public byte-level BPE vocabulary.

Texts up to ``LIMIT`` characters are encoded whole. A longer text is halved until every part is
short, wherever that cuts it, and the parts are encoded by separate tasks. They are then joined as
a tree. Around each join the text is encoded anew between the nearest places, left and right, that
no match of the vocabulary's pattern spans; where that stretch is a single piece of the pattern, a
growing window of tokens is, until it begins and ends with tokens that the two sides have there.
Adjacent tokens of one piece depend on no other tokens, so a sequence of which every adjacent pair
is part of some encoding is the encoding of the piece.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textform import by_size

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which the vocabulary splits text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 4_096  # characters
WINDOW = 8


@lru_cache(maxsize=4)
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary file as an encoder; read once per worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> str:
    return " " if c.isspace() else {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "o")


def _border(text: str, i: int) -> bool:
    """No match of the pattern goes over place i, and matching from i on needs nothing before."""
    a, b = text[i - 1], text[i]
    return _kind(a) != " " and a != "'" and _kind(a) != _kind(b)


def halves(text: str, limit: int) -> list[str]:
    """The leaves of a tree of halves, in order, none longer than ``limit`` characters."""
    if len(text) <= limit:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], limit) + halves(text[mid:], limit)


def join_tokens(enc: tiktoken.Encoding, a: list[int], b: list[int]) -> list[int]:
    """The encoding of one piece from those of its two parts."""
    if not a or not b:
        return a + b
    n = WINDOW
    while True:
        i, j = max(0, len(a) - n), min(len(b), n)
        mid = enc._encode_single_piece(enc.decode_bytes(a[i:] + b[:j]))
        left = i == 0 or mid[0] == a[i]
        right = j == len(b) or mid[-1] == b[j - 1]
        if (left and right) or (i == 0 and j == len(b)):
            return a[:i] + mid + b[j:]
        n *= 2


def _tokens_before(enc: tiktoken.Encoding, ids: list[int], size: int, back: bool = False) -> int:
    """How many of the first tokens (of the last, with ``back``) make up ``size`` bytes."""
    n, order = 0, reversed(ids) if back else ids
    for k, t in enumerate(order):
        if n >= size:
            return k
        n += len(enc.decode_single_token_bytes(t))
    return len(ids)


def join_texts(enc: tiktoken.Encoding, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """Text and encoding of two neighbours from those of each."""
    (s, a), (t, b) = left, right
    if not s or not t:
        return s + t, a + b
    both = s + t
    if _border(both, len(s)):
        return both, a + b
    lo, hi = len(s) - 1, len(s) + 1
    while lo > 0 and not _border(both, lo):
        lo -= 1
    while hi < len(both) and not _border(both, hi):
        hi += 1
    tail, head = _tokens_before(enc, a, len(s[lo:].encode()), True), _tokens_before(enc, b, len(both[len(s) : hi].encode()))
    stretch = both[lo:hi]
    body = stretch.removeprefix(" ")
    if len(body) >= len(stretch) - 1 and "'" not in stretch and _one_kind(body) and len(s) - lo > len(stretch) - len(body):
        mid = join_tokens(enc, a[len(a) - tail :], b[:head])
    else:
        mid = enc.encode_ordinary(stretch)
    return both, a[: len(a) - tail] + mid + b[head:]


def _one_kind(body: str) -> bool:
    """The characters are all letters, all numbers or all other marks: one match of the pattern."""
    kinds = set(map(_kind, set(body)))
    return len(kinds) == 1 and " " not in kinds


def join_tree(enc: tiktoken.Encoding, parts: list[tuple[str, list[int]]]) -> list[int]:
    """Neighbours joined level by level until one sequence is left."""
    while len(parts) > 1:
        parts = [join_texts(enc, parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0][1] if parts else []


def token_ids(df: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``(key, ids)`` of each row, without special tokens; null and empty texts have no ids (an
    empty list). Names of special tokens in a text are ordinary text. Repeated rows stay; other
    columns are ignored. Rows of a text longer than ``limit`` need a key that is not null.
    """
    df = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in by_size(batches, "t"):
            ids = [enc.encode_ordinary(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["k", "ids"])

    short = df.where(F.length("t") <= limit).mapInArrow(whole, f"k {dict(df.dtypes)['k']}, ids array<int>")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, uid, t in zip(b["k"], b["u"], b["t"]):
                parts = halves(t, limit)
                for lo in range(0, len(parts), 256):
                    yield pd.DataFrame({"k": k, "u": uid, "m": range(lo, min(lo + 256, len(parts))), "part": parts[lo : lo + 256]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            yield b.assign(ids=[enc.encode_ordinary(p) for p in b["part"]])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m")
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "u": pdf["u"].iloc[:1], "ids": [join_tree(encoder(path), [(p, list(x)) for p, x in zip(pdf["part"], pdf["ids"])])]})

    kind = dict(df.dtypes)["k"]
    long = df.where(F.length("t") > limit).withColumn("u", F.xxhash64("k", "t"))
    copies = long.groupBy("k", "u").agg(F.count("*").alias("copies"))
    parts = long.dropDuplicates(["k", "u"]).mapInPandas(split, f"k {kind}, u long, m int, part string")
    parts = parts.repartition(F.col("u"), F.col("m")).mapInPandas(encode, f"k {kind}, u long, m int, part string, ids array<int>")
    joined = parts.groupBy("k", "u").applyInPandas(join, f"k {kind}, u long, ids array<int>")
    joined = joined.join(copies, ["k", "u"]).select("k", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("k", "ids")
    return short.unionByName(joined).withColumnRenamed("k", key)


