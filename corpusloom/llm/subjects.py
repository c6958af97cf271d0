"""Problem 10: the subjects of each document.

Sentences are the units that are about something, so a document is the mixture of its sentences.
On a bounded sample of labelled documents the terms that discriminate between subjects are
counted (and weighed down if all documents hold them more often than the labelled ones), and
normalised sentence vectors over them are made, by the executors. Bisecting k-means
splits the vectors, the largest spread first and then every leaf that several subjects share.
Each leaf gets the subjects its sentences come from, weighed by how much of it they explain, with
its most discriminative terms as a label to read. Every document is then scanned once: its
sentences go down the tree, and it gets the subjects that enough of its sentences are about.

The driver never holds a text: what it collects are the terms that discriminate, and the numbers
of these terms in at most ``LABELLED_SENTENCES`` sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .textform import WORD, by_size, consistent, spans, word_hashes

# Bounds of the labelled sample that the model is fitted on; within both, all that is labelled.
LABELLED_DOCUMENTS, LABELLED_SENTENCES = 20_000, 400_000
LEAVES, MOST_LEAVES = 64, 512  # by spread; and with those split further, as several subjects share them
PURE, MIN_LEAF = 0.9, 6  # share of one subject beyond which, and sentences below which, a leaf stays whole
SHARE = 0.21  # between the sixth that passing mentions stay below and the quarter that counts
MIN_LIFT, TOP, MIN_DOCS = 1.5, 0.5, 3  # of a term: times its subject's share of documents, least part in it, documents

# Abbreviations whose full stop ends no sentence.
_ABBREVIATED = re.compile(r"(?i)\b(réf|ref|no|art|al|cf|vol|fig|p|pp|m|mm|dr|st|env|max|min|nos|etc)\.$")
_END = re.compile(r"[.!?…]+[\"»”)\]]*\s+|[\r\n]\s*|[.!?…]+[\"»”)\]]*$")


def sentences(text: str) -> list[str]:
    """The sentences of a text in the consistent form; marks without a word are none."""
    out, at, low = [], 0, consistent(text)
    for m in _END.finditer(low):
        piece = low[at : m.end()].strip()
        if low[m.start()] in ".!?…" and _ABBREVIATED.search(low[max(at, m.start() - 6) : m.start() + 1]):
            continue
        if low[m.start()] not in ".!?…" and piece and piece[-1] not in ".!?…:;»”" and low[m.end() : m.end() + 1].islower():
            continue
        if WORD.search(piece):
            out.append(piece)
        at = m.end()
    if WORD.search(low[at:]):
        out.append(low[at:].strip())
    return out


def _terms(sentence: str) -> list[str]:
    """Distinct words of two letters or more, without those that hold digits."""
    w = [x for x in WORD.findall(sentence.lower()) if x.isalpha() and len(x) > 1]
    return list(dict.fromkeys(w))


@dataclass
class SubjectModel:
    """Term weights, the tree of the bisecting k-means, and the subjects of its leaves."""

    subjects: list[str]
    terms: list[str]
    weight: np.ndarray
    hashes: np.ndarray = field(init=False)  # of the terms, sorted, with their numbers in ``order``
    order: np.ndarray = field(init=False)
    split: np.ndarray | None = None  # per inner node: centre 1 minus centre 0
    child: np.ndarray | None = None  # inner nodes from 0, leaves as ~leaf
    mixture: np.ndarray | None = None  # leaves x subjects
    label: list[list[str]] = field(default_factory=list)

    def __post_init__(self):
        hashes = word_hashes(self.terms)[0]
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct terms of each sentence: their numbers, and how many each sentence has."""
        h, counts = word_hashes([s.lower() for s in sentences])
        if not len(self.terms) or not len(h):
            return np.zeros(0, dtype=np.int64), np.zeros(len(sentences), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        owner, flat = np.divmod(np.unique(np.repeat(np.arange(len(sentences)), counts)[hit] * len(self.terms) + self.order[at[hit]]), len(self.terms))
        return flat, np.bincount(owner, minlength=len(sentences))

    def vectors(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of normalised vectors over the terms of each sentence, and their sentences."""
        owner = np.repeat(np.arange(len(counts)), counts)
        values = self.weight[flat]
        norm = np.sqrt(np.bincount(owner, values**2, minlength=len(counts)))
        return values / norm[owner], owner

    def leaves(self, sentences: list[str]) -> np.ndarray:
        """The leaf of each sentence; -1 for one without a discriminative term."""
        flat, counts = self.numbers(sentences)
        values, owner = self.vectors(flat, counts)
        n, known = len(sentences), counts > 0
        if self.split is None or not len(self.split):
            return np.where(known, 0, -1)
        node, active = np.zeros(n, dtype=np.int64), known.copy()
        while active.any():
            use = active[owner]
            o = owner[use]
            score = np.bincount(o, values[use] * self.split[node[o], flat[use]], minlength=n)
            node[active] = self.child[node[active], (score[active] > 0).astype(int)]
            active &= node >= 0
        return np.where(known, ~node, -1)

    def all_shares(self, texts: list[str | None]) -> np.ndarray:
        """The share of the sentences of each text that is about each subject."""
        split = [sentences(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        leaf = self.leaves([s for ss in split for s in ss])
        mix = np.vstack([self.mixture, np.zeros(len(self.subjects))])[leaf]
        out = np.zeros((len(texts), len(self.subjects)))
        np.add.at(out, np.repeat(np.arange(len(texts)), sizes), mix)
        return out / np.maximum(sizes, 1)[:, None]


class _Bisection:
    """Bisecting k-means of sparse unit vectors, given by terms, values and rows in order."""

    def __init__(self, flat: np.ndarray, values: np.ndarray, counts: np.ndarray, dims: int, rounds: int = 12):
        self.flat, self.values, self.dims, self.rounds = flat, values, dims, rounds
        self.start = np.r_[0, np.cumsum(counts)]
        self.groups = [np.flatnonzero(counts)]
        self.whole = [False]  # a leaf that no split parts
        self.place: list[tuple[int, int] | None] = [None]
        self.split: list[np.ndarray] = []
        self.child: list[list[int]] = []

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.groups[k]
        lens = self.start[ids + 1] - self.start[ids]
        pos = np.repeat(self.start[ids] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return self.flat[pos], self.values[pos], np.repeat(np.arange(len(ids)), lens)

    def centre(self, k: int) -> np.ndarray:
        f, v, _ = self.part(k)
        return np.bincount(f, v, minlength=self.dims)

    def spread(self, k: int) -> float:
        n = len(self.groups[k])
        return 0.0 if self.whole[k] or n < 2 else n - float((self.centre(k) ** 2).sum()) / n

    def bisect(self, k: int) -> bool:
        """Part leaf k in two, the second of them a new last leaf; False if it stays whole."""
        f, v, o = self.part(k)
        n = len(self.groups[k])
        # start from the row farthest from the centre and all others
        centre = np.bincount(f, v, minlength=self.dims)
        far = int(np.argmin(np.bincount(o, v * centre[f], minlength=n)))
        c0 = np.bincount(f[o == far], v[o == far], minlength=self.dims)
        c1 = centre - c0
        for _ in range(self.rounds + 1):
            c0, c1 = c0 / max(np.linalg.norm(c0), 1e-9), c1 / max(np.linalg.norm(c1), 1e-9)
            side = np.bincount(o, v * (c1 - c0)[f], minlength=n) > 0
            if side.all() or not side.any():
                self.whole[k] = True
                return False
            used = c1 - c0
            c0, c1 = np.bincount(f, v * ~side[o], minlength=self.dims), np.bincount(f, v * side[o], minlength=self.dims)
        node = len(self.split)
        self.split.append(used)
        self.child.append([~k, ~len(self.groups)])
        if self.place[k] is not None:
            parent, which = self.place[k]
            self.child[parent][which] = node
        self.place[k] = (node, 0)
        self.place.append((node, 1))
        self.whole.append(False)
        self.groups.append(self.groups[k][side])
        self.groups[k] = self.groups[k][~side]
        return True

    def by_spread(self, leaves: int) -> None:
        spreads = [self.spread(0)]
        while len(self.groups) < leaves and (k := int(np.argmax(spreads))) >= 0 and spreads[k] > 1e-9:
            if self.bisect(k):
                spreads.append(self.spread(len(self.groups) - 1))
            spreads[k] = self.spread(k)


def _mixtures(tree: _Bisection, document: np.ndarray, held: np.ndarray, steps: int = 20) -> np.ndarray:
    """Shares of the subjects in each leaf: the labels of a document share out its sentences, by
    expectation and maximisation. ``held``: documents x subjects."""
    leaf = np.concatenate([np.full(len(g), k) for k, g in enumerate(tree.groups)])
    pair, n = np.unique(document[np.concatenate(tree.groups)] * len(tree.groups) + leaf, return_counts=True)
    doc, leaf = np.divmod(pair, len(tree.groups))
    mix = np.ones((len(tree.groups), held.shape[1]))
    for _ in range(steps):
        r = held[doc] * mix[leaf]
        r *= (n / np.maximum(r.sum(axis=1), 1e-9))[:, None]
        mix = np.stack([np.bincount(leaf, r[:, j], minlength=len(tree.groups)) for j in range(held.shape[1])], axis=1)
        mix /= np.maximum(mix.sum(axis=1, keepdims=True), 1e-9)
    return mix


def grow(model: SubjectModel, flat: np.ndarray, counts: np.ndarray, document: np.ndarray, held: np.ndarray) -> SubjectModel:
    """The tree, mixtures and labels of a model from the term numbers of sentences, the number of
    the document of each, and the subjects of the documents (0 and 1)."""
    tree = _Bisection(flat, model.vectors(flat, counts)[0], counts, len(model.terms))
    if len(model.terms):
        tree.by_spread(LEAVES)
    mix = _mixtures(tree, document, held)
    while impure := [k for k, g in enumerate(tree.groups) if len(g) >= MIN_LEAF and not tree.whole[k] and mix[k].max() < PURE]:
        done = [tree.bisect(k) for k in impure if len(tree.groups) < MOST_LEAVES]
        if not any(done):
            break
        mix = _mixtures(tree, document, held)
    model.split, model.child = np.array(tree.split, dtype=np.float32), np.array(tree.child, dtype=np.int64)
    model.mixture = np.where(mix >= 0.5, 1.0, np.where(mix >= 0.25, mix, 0.0))
    model.label = [[model.terms[i] for i in np.argsort(-tree.centre(k), kind="stable")[:5]] for k in range(len(tree.groups))]
    return model


def _term_counts(labelled: DataFrame, names: list[str]) -> DataFrame:
    """``(term, n, p0, p1, ...)``: documents with a term, and by subject the millionths that it
    counts for; a term counts by the share of sentences with it, so mentions in passing weigh little."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {s: j for j, s in enumerate(names)}
        for b in batches:
            for lo, hi in spans(b["t"].str.len().tolist()):
                got: dict[str, list[int]] = {}
                for text, ys in zip(b["t"][lo:hi].tolist(), b["subjects"][lo:hi].tolist()):
                    split = sentences(text)
                    for t, k in Counter(t for s in split for t in _terms(s)).items():
                        row = got.setdefault(t, [0] * (len(names) + 1))
                        row[0] += 1
                        for y in ys:
                            row[at[y] + 1] += round(1e6 * min(1.0, 3 * k / len(split)))
                if got:
                    yield pd.DataFrame([(t, *row) for t, row in got.items()], columns=["term", "n", *cols])

    cols = [f"p{j}" for j in range(len(names))]
    rows = labelled.mapInPandas(run, "term string, n long" + "".join(f", {c} long" for c in cols))
    return rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", *cols)])


def _discriminative(counts: DataFrame, base: dict[str, float], names: list[str]) -> DataFrame:
    """``(term, n, lift, top)`` of the terms that one subject has far more than its share of."""
    p = [F.col(f"p{j}") for j in range(len(names))]
    whole = F.greatest(sum(p[1:], p[0]), F.lit(1))
    top = F.array_max(F.array(*p)) / whole
    lift = F.array_max(F.array(*[x / whole / base[s] for x, s in zip(p, names)]))
    c = counts.where(F.col("n") >= MIN_DOCS).select("term", "n", lift.alias("lift"), top.alias("top"))
    return c.where(f"lift >= {MIN_LIFT} and top >= {TOP}")


def _document_counts(texts: DataFrame, model: SubjectModel) -> tuple[int, np.ndarray]:
    """How many texts there are in all, and how many hold each term of the model: a partial count
    for each task."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(held.value.terms), dtype=np.int64)
        for b in by_size(batches, "t"):
            flat, _ = held.value.numbers([consistent(t) for t in b.column("t").to_pylist()])
            total += np.bincount(flat, minlength=len(total))
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"term": np.arange(-1, len(total)), "n": np.r_[n, total]})

    got = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(model.terms) + 1, dtype=np.int64)
    out[got["term"].to_numpy() + 1] = got["n"].to_numpy()
    return int(out[0]), out[1:]


def _sentence_numbers(labelled: DataFrame, model: SubjectModel) -> DataFrame:
    """``(k, no, terms)``: document, number of the sentence in it, numbers of its terms; only
    sentences with some term."""
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "t", 500):
            split = [sentences(t) for t in b.column("t").to_pylist()]
            flat, counts = held.value.numbers([s for ss in split for s in ss])
            if not len(flat):
                continue
            sizes = [len(ss) for ss in split]
            owner = pa.array(np.repeat(np.arange(len(split)), sizes)[counts > 0])
            no = np.concatenate([np.arange(n) for n in sizes])[counts > 0]
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts[counts > 0])].astype(np.int32), flat.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("k").take(owner), pa.array(no, pa.int32()), lists], names=["k", "no", "terms"])

    return labelled.select("k", "t").mapInArrow(run, f"k {dict(labelled.dtypes)['k']}, no int, terms array<int>")


def fit_labelled(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> SubjectModel:
    """The model of at most ``LABELLED_DOCUMENTS`` labelled documents and ``LABELLED_SENTENCES`` of
    their sentences, chosen by a hash of their key; deterministic. No labels: it finds no subject."""
    some = labels.where(F.col("subject").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.collect_set("subject").alias("subjects"))
    some = some.orderBy(F.xxhash64("k"), "k").limit(LABELLED_DOCUMENTS)
    labelled = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(some), "k")
    labelled = cut(labelled.groupBy("k").agg(F.max("t").alias("t"), F.max("subjects").alias("subjects")))
    base = {r[0]: r[1] for r in labelled.select(F.explode("subjects").alias("s")).groupBy("s").count().collect()}
    names = sorted(base)
    if not names:
        return SubjectModel([], [], np.zeros(0), mixture=np.zeros((1, 0)))
    shares = {s: base[s] / sum(base.values()) for s in names}
    terms = _discriminative(_term_counts(labelled, names), shares, names).orderBy("term").toArrow()
    # a term that all documents hold more often than the labelled ones is about something else there
    n, every = _document_counts(df.select(F.col(text).alias("t")).where("t is not null"), SubjectModel(names, terms["term"].to_pylist(), np.zeros(len(terms))))
    own = np.minimum(1, terms["n"].to_numpy() / labelled.count() * n / np.maximum(every, 1))
    lift, top = terms["lift"].to_numpy() * own, terms["top"].to_numpy() * own
    keep = (lift >= MIN_LIFT) & (top >= TOP)
    model = SubjectModel(names, [t for t, k in zip(terms["term"].to_pylist(), keep) if k], ((np.log(np.maximum(lift, 1)) * top) ** 2)[keep])
    rows = _sentence_numbers(labelled, model).orderBy(F.xxhash64("k", "no"), "k", "no").limit(LABELLED_SENTENCES).toArrow().sort_by([("k", "ascending"), ("no", "ascending")])
    docs = labelled.select("k", "subjects").toArrow().sort_by("k")
    held = np.array([[s in ys for s in names] for ys in map(set, docs["subjects"].to_pylist())], dtype=float)
    at = pc.index_in(rows["k"], docs["k"].combine_chunks()).to_numpy()
    lists = rows["terms"].combine_chunks()
    return grow(model, lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(), at, held)


def document_subjects(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``(key, subject)`` of each document and subject that ``share`` of its sentences are about.

    Null, blank and empty texts and texts without discriminative terms have no row; so has every
    document if nothing is labelled. Repeated rows come out once; other columns are ignored.
    """
    model = df.sparkSession.sparkContext.broadcast(fit_labelled(df, labels, key, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            for lo, hi in spans(b[text].str.len().tolist()):
                part = b.iloc[lo:hi]
                shares = m.all_shares(part[text].tolist())
                r, c = np.nonzero(shares >= share)
                if len(r):
                    yield pd.DataFrame({"k": part[key].to_numpy()[r], "subject": [m.subjects[j] for j in c]})

    kind = dict(df.dtypes)[key]
    hits = df.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInPandas(run, f"k {kind}, subject string")
    return hits.select(F.col("k").alias(key), "subject").distinct()
