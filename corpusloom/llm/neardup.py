"""Problem 2: groups of near-duplicate rows by a chosen-path set similarity join; problem 5 on top.

Each row is the set of its distinct sequences of consecutive words. Rows with equal sets become
one representative first. In each of several independent trees a representative walks from the
root: at every node some positions of its minhash vector are chosen by a hash of the path, and
the minwise tokens there name the children it goes to. Rows that meet in a node of the last
level are compared by a sketch of their sets that bounds how many members differ. Pairs that pass
the sketch are checked against the exact sets, and the groups are the connected components of the
pairs that hold. Whether two rows are compared depends on these two only, not on what else there is.

What is shuffled: 20 narrow entries for each representative, and the token sets of those rows
only that are in some candidate pair. No task gets a whole key: nodes too large to compare are
found by counters of fixed size before their rows meet, and are compared block by block, every
pair of blocks in a task of its own. The comparisons are quadratic in the rows of a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, sized
from .lines import LineDropper, repeated_lines
from .textform import by_size, consistent, word_hashes

SHINGLE, THRESHOLD, MIN_WORDS = 3, 0.5, 20
TREES, BRANCHES = 10, (2, 1, 1)
MINHASHES = 32
BITS, CLASSES = 248, 256  # of a sketch; the classes of set sizes, 16 for each doubling
SAMPLED, DEVIATIONS = 224, 3.3  # sets beyond that size are sampled for the sketch; a pair at the threshold may be so far off
NODE, BLOCKS = 4096, 64  # rows compared in one task; blocks of half as many that a node is cut into at most, larger ones beyond
DEPTH = len(BRANCHES)  # of the nodes in which rows meet, however large; nothing reads it
DENSE, TILE = 64, (32, 4096)  # rows of a node that are compared in tiles; size of a tile, which fits a core's cache
COUNTERS = 1 << 16, 1 << 20  # fewest and most; one for each 64 entries between. More entries than the most can tell apart are counted by node

SKETCH = ["s1", "s2", "s3", "s4"]
_SKETCHED = ", ".join(f"{s} long" for s in SKETCH)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SALTS = np.random.default_rng(20260101).integers(1, 1 << 62, size=MINHASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(a: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text (of all its words, if fewer), in order.

    ``a`` has the word hashes of all texts, ``lens`` how many each has, at least one. Returns the
    run hashes in one array, their number for each text and a hash of each whole text.
    """
    ends, at = np.cumsum(lens), np.arange(len(a))
    left = np.repeat(ends, lens) - at
    h = np.zeros(len(a), dtype=np.uint64)
    for k in range(n):
        h = (h ^ np.where(left > k, np.concatenate([a[k:], np.zeros(k, dtype=np.uint64)]), np.uint64(0))) * _M2
        h ^= h >> np.uint64(29)
    keep = (left >= n) | (left == np.repeat(lens, lens))
    counts = np.maximum(lens - n + 1, 1)
    place = (at - np.repeat(ends - lens, lens) + 1).astype(np.uint64)
    whole = np.add.reduceat((a ^ place * _M3) * _M1 ^ (a >> np.uint64(31)), ends - lens)
    return h[keep], counts, whole


def _minhashes(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The minhash vectors (32 bits each) of a batch."""
    starts = np.cumsum(counts) - counts
    mins = np.empty((len(counts), MINHASHES), dtype=np.uint64)
    for k, salt in enumerate(_SALTS):
        x = flat * salt
        x ^= x >> np.uint64(32)
        x *= _M1
        mins[:, k] = np.minimum.reduceat(x, starts)
    mins ^= mins >> np.uint64(30)
    mins *= _M3
    return (mins >> np.uint64(28)).astype(np.uint32).view(np.int32)


def _level(size_class: np.ndarray) -> np.ndarray:
    """How often sets of a class are halved before they are sketched."""
    return np.maximum(0, np.ceil(size_class / 16 - np.log2(SAMPLED))).astype(np.int64)


def _sketches(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Odd sketches of the sets of a batch, four words each: every distinct member flips one of
    ``BITS`` bits, so the sketches of two sets differ by the members that only one has. The last
    byte is the class of the set's size; members of large sets are sampled by hash."""
    rows = len(counts)
    x = (flat ^ (flat >> np.uint64(31))) * _M3
    owner = np.repeat(np.arange(rows, dtype=np.uint64), counts)
    both = np.unique(owner << np.uint64(48) | x >> np.uint64(16))
    owner, x = (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
    sizes = np.bincount(owner, minlength=rows)
    classes = np.minimum(np.round(16 * np.log2(np.maximum(sizes, 1))), CLASSES - 1).astype(np.int64)
    kept = (x >> np.uint64(24)) & ((np.uint64(1) << _level(classes).astype(np.uint64)) - np.uint64(1))[owner] == 0
    place = owner[kept] * 256 + ((x[kept] & np.uint64((1 << 24) - 1)) % np.uint64(BITS)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=rows * 256) & 1).astype(np.uint8).reshape(rows, 256), axis=1)
    packed[:, 31] = classes
    return packed.view(np.int64)


@lru_cache(maxsize=8)
def most_bits(threshold: float) -> np.ndarray:
    """For each two size classes the most bits in which the sketches of sets with a similarity of
    ``threshold`` may differ, ``DEVIATIONS`` from their mean: -1 if the sizes alone tell that they
    are less alike, all bits if the sketches say nothing (sampled at different rates)."""
    c = np.arange(CLASSES)
    lo, hi, level = 2 ** ((c - 0.5) / 16), 2 ** ((c + 0.5) / 16), _level(c)
    rate = 0.5 ** level[:, None]
    differ = (hi[:, None] + hi[None, :]) * (1 - threshold) / (1 + threshold) * rate
    one, two = (1 - 2 / BITS) ** differ, (1 - 4 / BITS) ** differ
    deviation = np.sqrt(np.maximum(0, BITS / 4 * (1 - two) + BITS**2 / 4 * (two - one**2)) + one**2 * differ * (1 - rate))
    most = np.minimum(BITS / 2 * (1 - one) + DEVIATIONS * deviation, BITS)
    most = np.where((level[:, None] != level[None, :]) | (np.maximum(c[:, None], c[None, :]) == CLASSES - 1), BITS, most)
    return np.where(threshold * np.maximum(lo[:, None], lo[None, :]) > np.minimum(hi[:, None], hi[None, :]), -1, most).astype(np.int16)


def word_sets(df: DataFrame, dropper: LineDropper | None, shingle: int, min_words: int, signed: bool) -> DataFrame:
    """``row_id`` with either hash of the set, minhash vector and sketch, or the set itself.

    Sets are of 32-bit hashes when they come out, which is what the exact check compares.
    """
    flags = dropper.flags if dropper else None

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, "content"):
            rows, texts = [], []
            for row, issuer, content, drop in zip(*[b.column(k).to_pylist() for k in range(4)]):
                text = consistent(content).lower()
                if flags:
                    lines = text.split("\n")
                    text = "\n".join([x for x, f in zip(lines, flags(issuer, lines, drop)) if not f])
                rows.append(row), texts.append(text)
            words, lens = word_hashes(texts)
            keep = lens >= max(1, min_words)
            if not keep.any():
                continue
            words, lens, rows = words[np.repeat(keep, lens)], lens[keep], np.array(rows, dtype=np.int64)[keep]
            flat, counts, whole = shingle_hashes(words, lens, shingle)
            if signed:
                vector, sketch = _minhashes(flat, counts), np.ascontiguousarray(_sketches(flat, counts).T)
                cols = [pa.array(rows, pa.int64()), pa.array(whole.view(np.int64)), lists(vector.ravel(), np.full(len(rows), MINHASHES)), *map(pa.array, sketch)]
                yield pa.RecordBatch.from_arrays(cols, names=["row_id", "whole", "mh", *SKETCH])
            else:
                parts = [np.unique(x) for x in np.split((flat >> np.uint64(32)).astype(np.uint32).view(np.int32), np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), lists(np.concatenate(parts), np.array([len(x) for x in parts]))], names=["row_id", "tokens"])

    df = df.select("row_id", "emetteur", "content", *(["drop"] if "drop" in df.columns else []))
    if "drop" not in df.columns:
        df = df.withColumn("drop", F.lit(None).cast("array<long>"))
    return df.where("content is not null and row_id is not null").mapInArrow(run, f"row_id long, whole long, mh array<int>, {_SKETCHED}" if signed else "row_id long, tokens array<int>")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * _M1)) * _M2
    return (x ^ (x >> np.uint64(29))) * _M3


def _children(path: np.ndarray, minhash: np.ndarray, width: int) -> list[np.ndarray]:
    """The nodes one level below ``path``: for each branch the path chooses a position of the
    minhash vector, and the minwise token there names the child."""
    out = []
    for b in range(width):
        at = _mix(path, np.full(1, b + 1, dtype=np.uint64))
        token = minhash[np.arange(len(path)), (at >> np.uint64(33)) % np.uint64(MINHASHES)]
        out.append(_mix(at, token.astype(np.uint32).astype(np.uint64)))
    return out


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("mh").flatten().to_numpy(zero_copy_only=False).reshape(-1, MINHASHES)


def _entries(rows: DataFrame, counters: int | None = None) -> DataFrame:
    """An entry (node, row_id, sketch) for each node of the last level that a row reaches. With
    ``counters`` their partial sums (c, n) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters or 0, dtype=np.int64)
        for batch in batches:
            minhash = _vectors(batch)
            paths = [np.full(len(minhash), t + 1, dtype=np.uint64) for t in range(TREES)]
            for width in BRANCHES:
                paths = [c for p in paths for c in _children(p, minhash, width)]
            nodes = np.concatenate(paths).view(np.int64)
            if counters:
                total += np.bincount(nodes & (counters - 1), minlength=counters)
            else:
                rest = [pa.array(np.tile(batch.column(c).to_numpy(), len(paths))) for c in ("row_id", *SKETCH)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), *rest], names=["node", "row_id", *SKETCH])
        if counters:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["c", "n"])

    return rows.mapInArrow(run, "c long, n long" if counters else f"node long, row_id long, {_SKETCHED}")


def _tiles(words: list[np.ndarray], classes: np.ndarray, x: np.ndarray, y: np.ndarray | None, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the rows ``x`` with the rows ``y``, or with each other, those whose sketches may be of sets
    alike. Both are taken in the order of their classes, so what their sizes exclude is not compared."""
    below, alike, alone = (most + 1).astype(np.uint8), most >= 0, y is None
    low, high = alike.argmax(axis=1), CLASSES - alike[:, ::-1].argmax(axis=1)
    x = x[np.argsort(classes[x], kind="stable")]
    y = x if alone else y[np.argsort(classes[y], kind="stable")]
    of_x, of_y, kinds = [w[x, None] for w in words], [w[y] for w in words], classes[y]
    for r in range(0, len(x), TILE[0]):
        c = classes[x[r : r + TILE[0]]]
        begin, end = np.searchsorted(kinds, [low[c[0]], high[c[-1]]])
        limits = below[c]
        for k in range(max(begin, r) if alone else begin, end, TILE[1]):
            stop = min(k + TILE[1], end)
            bits = np.zeros((len(c), stop - k), dtype=np.uint8)
            for v, w in zip(of_x, of_y):
                bits += np.bitwise_count(v[r : r + TILE[0]] ^ w[k:stop])
            i, j = np.nonzero(bits < limits.take(kinds[k:stop], axis=1))
            if alone:
                i, j = i[j + k > i + r], j[j + k > i + r]
            if len(i):
                yield x[i + r], y[j + k]


def _meet(entries: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a < b`` within each node whose sketches may be of sets alike. Nodes come whole and in
    order, one behind the other, whatever the batches; a batch ends within a node at most once."""
    most, size, sided = most_bits(threshold), np.uint64(0xFF) << np.uint64(56), "side" in entries.columns

    def batch_of(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        ab = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])

    def pairs(node: np.ndarray, ids: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = [w.view(np.uint64) for w in rest[: len(SKETCH)]]
        classes = (words[-1] >> np.uint64(56)).astype(np.int64)  # the last byte, as the words are little-endian
        words[-1] = words[-1] & ~size
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[starts, len(node)])
        ends, first = np.repeat(np.r_[starts[1:], len(node)], sizes), np.arange(len(node)) + 1
        if sided:  # rows of side 1 meet those of side 2 only
            side = rest[-1]
            second = ends - np.repeat(np.add.reduceat((side == 2).astype(np.int64), starts), sizes)
            first = np.where(side == 0, first, np.where(side == 1, second, ends))
        for at, end in zip(starts[sizes >= DENSE], starts[sizes >= DENSE] + sizes[sizes >= DENSE]):
            x, y, kept, held = np.arange(at, end), None, [], 0
            if sided and side[at]:
                x, y = np.split(x, [second[at] - at])
            for ij in _tiles(words, classes, x, y, most):
                kept.append(ij)
                held += len(ij[0])
                if held > 1_000_000:
                    yield batch_of(ids, *map(np.concatenate, zip(*kept)))
                    kept, held = [], 0
            if kept:
                yield batch_of(ids, *map(np.concatenate, zip(*kept)))
        more = np.where(np.repeat(sizes >= DENSE, sizes), 0, ends - first)
        for part in np.array_split(np.flatnonzero(more), int(more.sum()) // 1_000_000 + 1):
            r = more[part]
            i = np.repeat(part, r)
            j = np.repeat(first[part], r) + np.arange(len(i)) - np.repeat(np.cumsum(r) - r, r)
            allowed = most[classes[i], classes[j]]
            i, j, allowed = (x[allowed >= 0] for x in (i, j, allowed))
            bits = np.zeros(len(i), dtype=np.int16)
            for w in words:
                bits += np.bitwise_count(w[i] ^ w[j])
            i, j = i[bits <= allowed], j[bits <= allowed]
            if len(i):
                yield batch_of(ids, i, j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols)]
            if not len(cols[0]):
                continue
            ends = np.flatnonzero(cols[0] != cols[0][-1])
            cut_at = ends[-1] + 1 if len(ends) else 0
            left = [c[cut_at:] for c in cols]
            if cut_at:
                yield from pairs(*[c[:cut_at] for c in cols])
        if left is not None:
            yield from pairs(*left)

    ordered = entries.repartition(F.col("node")).sortWithinPartitions("node", *["side"] * sided)
    return ordered.mapInArrow(run, "a long, b long").where("a < b")


def _heavy(rows: DataFrame, entries: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The entries with a column ``c``, and the values of it at which more than ``NODE`` rows may
    meet. Counters of fixed size tell them before any entry is moved; where there are more entries
    than counters can tell apart, the nodes are counted one by one."""
    counters = min(max(1 << (n // 64).bit_length(), COUNTERS[0]), COUNTERS[1])
    if 4 * n <= NODE * counters:
        counts = _entries(rows, counters).groupBy("c").agg(F.sum("n").alias("n"))
        entries = entries.withColumn("c", F.col("node").bitwiseAND(F.lit(counters - 1)))
    else:
        entries = entries.withColumn("c", F.col("node"))
        counts = entries.groupBy("c").agg(F.count("*").alias("n"))
    heavy, _ = sized(counts.where(F.col("n") > NODE).select("c"))
    return entries, heavy


def candidate_pairs(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs of representatives that meet in a node and have like sketches: in large nodes
    all pairs too, so whether a pair is found does not depend on how many rows there are.

    ``reps``: row_id, mh and sketch; read several times, so a materialised table.
    """
    entries, heavy = _heavy(reps, _entries(reps), reps.count() * TREES * int(np.prod(BRANCHES)))
    if heavy.isEmpty():
        return _meet(entries.drop("c"), threshold).distinct()
    pairs = _meet(entries.join(heavy, "c", "left_anti").drop("c"), threshold)
    return pairs.unionByName(_meet(_blocks(entries.join(heavy, "c").drop("c")), threshold)).distinct()


def _blocks(large: DataFrame) -> DataFrame:
    """Entries of large nodes as nodes of about ``NODE`` rows in which all their pairs meet: a row
    goes to each pair of blocks that its own is in, so to at most ``BLOCKS``; blocks of the very
    largest nodes are larger. ``side`` tells the two blocks of a pair apart, and is 0 where a block
    meets itself."""
    size, _ = sized(large.groupBy("node").count().where(F.col("count") > NODE).select("node", F.least(F.ceil(2 * F.col("count") / NODE), F.lit(BLOCKS)).alias("blocks")))
    own = large.join(size, "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    own = own.withColumn("own", F.pmod(F.xxhash64("row_id"), "blocks")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("k"), 0).when(F.col("own") < F.col("k"), 1).otherwise(2).alias("side")
    return own.select(F.xxhash64("node", F.least("own", "k"), F.greatest("own", "k")).alias("node"), "row_id", *SKETCH, side)


def _jaccard_pairs(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a, b = sets.toDF("a", "ta"), sets.toDF("b", "tb")
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").where(both >= threshold * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """``(id, least)`` of each id in ``(a, b)``: the least id of its connected component.

    Alternating large-star and small-star steps, each a grouped minimum and a join, until the
    edges stay the same; every step is cut, so lost executors cost one step.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        new = both.join(least, "u")
        if large:
            return new.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return new.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    edges = cut(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).alias("mark")
    before = edges.select(mark).first()["mark"]
    while True:
        edges = cut(star(star(edges, True), False))
        now = edges.select(mark).first()["mark"]
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("least")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("least"))).distinct()


def members(df: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, drop_lines: bool = True) -> DataFrame:
    """``(row_id, whole, group)`` of every row that is in a group of two or more; ``whole`` is the
    hash of the canonical row, so rows that are equal but for case, punctuation and blanks share it.

    ``df`` has row_id, document_id, emetteur, content; other columns are ignored, a row taken in
    twice under one row_id counts once. Two rows are alike if the Jaccard similarity of their
    sets of ``shingle`` consecutive words is at least ``threshold``; rows alike to a common row
    are in one group, named by its least representative. Rows with null content, null row_id or
    fewer than ``min_words`` words are in no group. An empty table gives no rows.
    """
    dropper = LineDropper(repeated_lines(df, bands=1)) if drop_lines else None
    ready = dropper.prepare(df) if dropper else df
    rows = cut(word_sets(ready, dropper, shingle, min_words, True))
    first = rows.groupBy("whole").agg(F.min("row_id").alias("rep"), F.max("row_id").alias("last")).where("rep < last").select("whole", "rep")
    copies = cut(rows.select("row_id", "whole").join(first, "whole").select("row_id", "whole", "rep"))
    others, _ = sized(copies.where("row_id <> rep").select("row_id"))
    reps = rows.join(others, "row_id", "left_anti").select("row_id", "whole", "mh", *SKETCH)
    pairs = cut(candidate_pairs(reps.drop("whole"), threshold))
    ids, _ = sized(pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct())
    sets = word_sets(ready.join(ids, "row_id", "left_semi"), dropper, shingle, min_words, False)
    comp = components(_jaccard_pairs(pairs, sets, threshold))
    near = copies.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("row_id", "whole", F.coalesce("least", "rep").alias("group"))
    single = reps.select("row_id", "whole").join(comp.withColumnRenamed("id", "row_id"), "row_id").select("row_id", "whole", F.col("least").alias("group"))
    return near.unionByName(single).distinct()


def groups(df: DataFrame, **how) -> DataFrame:
    """``(row_id, group)`` of ``members``."""
    return members(df, **how).select("row_id", "group").distinct()


def group_pairs(members: DataFrame) -> DataFrame:
    """All pairs of rows within one group; for results whose definition asks for them."""
    a, b = members.toDF("row_id_a", "group"), members.toDF("row_id_b", "group")
    return a.join(b, "group").where("row_id_a < row_id_b").select("row_id_a", "row_id_b")
