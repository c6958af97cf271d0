"""Problem 9: passages of evaluation texts inside training texts.

The runs of n words of all evaluation texts, hashed to 64 bits, are a set that goes to every task;
the word windows of a training text are hashed a batch at once and looked up in it. Hits are
verified on the words of both texts. The set is broadcast if it has at most ``BROADCAST_RUNS``
distinct runs (16 bytes each); beyond that the windows are joined with it by hash, after a filter
of fixed size (``FILTER_BITS``) has taken out nearly all windows that cannot hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, sized
from .neardup import shingle_hashes
from .textform import WORD, by_size, consistent, word_hashes

RUN = 18
BROADCAST_RUNS = 2_000_000
FILTER_BITS = 1 << 27


def _lower(text: str) -> str:
    """Lower case that keeps every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _words(text: str) -> list[str]:
    return WORD.findall(_lower(consistent(text)))


def _windows(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``run`` words of each text, in order, and how many each has."""
    words, lens = word_hashes([_lower(consistent(t)) for t in texts])
    long = lens >= run
    if not long.any():
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    h, counts, _ = shingle_hashes(words[np.repeat(long, lens)], lens[long], run)
    out = np.zeros(len(texts), dtype=np.int64)
    out[long] = counts
    return h.view(np.int64), out


class _Filter:
    """Tells windows that may be a run of an evaluation text. ``runs``: sorted hashes, or None with
    ``bits``, a bit for each value of the last bits of a hash."""

    def __init__(self, runs: np.ndarray | None, bits: np.ndarray | None = None):
        self.runs, self.bits = runs, bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.runs is not None:
            if not len(self.runs):
                return np.zeros(len(h), dtype=bool)
            return self.runs[np.minimum(np.searchsorted(self.runs, h), len(self.runs) - 1)] == h
        at = h & (FILTER_BITS - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _run_rows(df: DataFrame, run: int, only=None) -> DataFrame:
    """``(k, h)``: the distinct runs of each text of ``df`` (k, t); with ``only``, a broadcast
    filter, those that pass it."""
    kind = dict(df.dtypes)["k"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "t"):
            h, counts = _windows(b.column("t").to_pylist(), run)
            owner = np.repeat(np.arange(len(counts)), counts)
            if only is not None:
                keep = only.value(h)
                h, owner = h[keep], owner[keep]
            if len(h):
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(owner)), pa.array(h)], names=["k", "h"])

    return df.mapInArrow(rows, f"k {kind}, h long").distinct()


def _hits(docs: DataFrame, held: DataFrame, run: int, limit: int) -> DataFrame:
    """``(k, h, item)``: runs of training texts that an evaluation text has too, verified on the
    words of both. ``docs``: k, t; ``held``: k, t."""
    sc = docs.sparkSession.sparkContext
    runs = cut(_run_rows(held, run).withColumnRenamed("k", "item"))
    distinct = runs.select("h").distinct()
    if distinct.count() <= limit:
        known = _Filter(np.sort(distinct.toArrow()["h"].to_numpy()))
    else:
        at = distinct.select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at"))
        got = at.groupBy(F.expr("shiftright(at, 3)").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at & 7 as int)))").alias("bits")).toArrow()
        bits = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
        bits[got["byte"].to_numpy()] = got["bits"].to_numpy()
        known = _Filter(None, bits)
    own = cut(_run_rows(docs, run, sc.broadcast(known)))
    small, _ = sized(runs, limit)
    hits = cut(own.join(small, "h"))
    pairs = hits.select("k", "item").distinct()
    ids, _ = sized(pairs.select("k").distinct())
    texts = docs.join(ids, "k", "left_semi").groupBy("k").agg(F.collect_set("t").alias("ts"))
    wanted = held.groupBy(F.col("k").alias("item")).agg(F.collect_set("t").alias("us"))
    kinds = dict(pairs.dtypes)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def grams(text: str) -> set[tuple[str, ...]]:
            w = _words(text)
            return set(zip(*[w[i:] for i in range(run)]))

        for b in batches:
            same = [any(grams(t) & grams(u) for t in ts for u in us) for ts, us in zip(b["ts"], b["us"])]
            yield b.loc[same, ["k", "item"]]

    sure = pairs.join(texts, "k").join(wanted, "item").select("k", "item", "ts", "us").mapInPandas(verify, f"k {kinds['k']}, item {kinds['item']}")
    return hits.join(cut(sure), ["k", "item"], "left_semi")


def _columns(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")


def leaks(df: DataFrame, evaluation: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", item: str = "row_id", content: str = "content", limit: int = BROADCAST_RUNS) -> DataFrame:
    """``(key, item)`` of every training text and evaluation text that share ``run`` consecutive
    words, whatever letter case, punctuation and white space between them.

    Null and empty texts and texts of fewer than ``run`` words share nothing; other columns are
    ignored; repeated rows come out once; empty tables give no rows.
    """
    hits = _hits(_columns(df, key, text), _columns(evaluation, item, content), run, limit)
    return hits.select(F.col("k").alias(key), F.col("item").alias(item)).distinct()


def remove_leaks(df: DataFrame, evaluation: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", item: str = "row_id", content: str = "content", limit: int = BROADCAST_RUNS) -> DataFrame:
    """``(key, text, removed)``: each training text in the consistent form without the spans of
    its leaked windows, and the number of words taken out. Null stays null with 0 removed; rows
    with a null key are left out. Each text gets the hashes of its own leaked runs by a join."""
    hits = _hits(_columns(df, key, text), _columns(evaluation, item, content), run, limit)
    own = hits.groupBy(F.col("k").alias(key)).agg(F.collect_set("h").alias("_leaked"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, removed = [], []
            for t, leaked in zip(b[text].tolist(), b["_leaked"].tolist()):
                n = 0
                if t is not None and leaked is not None:
                    form = consistent(t)
                    spans = [m.span() for m in WORD.finditer(_lower(form))]
                    start = np.flatnonzero(np.isin(_windows([t], run)[0], np.asarray(leaked)))
                    gone = np.zeros(len(spans) + 1, dtype=np.int64)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + run, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    n, keep, at = int(gone.sum()), [], 0
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    for lo, hi in zip(edges[::2], edges[1::2]):
                        keep.append(form[at : spans[lo][0]])
                        at = spans[hi - 1][1]
                    t = "".join([*keep, form[at:]])
                texts.append(t), removed.append(n)
            yield pd.DataFrame({key: b[key], text: texts, "removed": removed})

    kind = dict(df.dtypes)[key]
    return df.select(key, text).where(F.col(key).isNotNull()).join(own, key, "left").mapInPandas(clean, f"{key} {kind}, {text} string, removed long")
