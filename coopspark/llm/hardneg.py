"""Hard negatives by a secondary sort: per anchor, scores in falling order, in one stream.

Anchors meet all rows in blocks: rows are dealt to blocks by a hash, anchors are
copied to each block (a block is copied for each ``ASKED`` anchors), and a task
multiplies a bounded number of anchors with its block at a time. What leaves a
block is what can still count:

1. an anchor's best ``positives`` rows of its own label in the block; of all
   blocks' the best ``positives`` are the anchor's;
2. with these known, for each of their windows the block's first ``negatives``
   rows of another label.

Scores then go through the secondary sort: (anchor, falling score, positive
first, id) is packed into a key of bytes that sort in this order, and
``repartitionAndSortWithinPartitions`` deals it out by anchor. An iterator runs
over each partition: a positive opens its window, a negative is given to every
open window that has room, and a window closes below its lower end. It holds the
open windows of one anchor, ``positives`` of them at most, never an anchor's rows.

Scores are exact integers: sums of products in single or double precision where
these hold every partial sum, else in Python's integers (clipped to 64 bits).

Defined cases: rows with a null id, a null label, a null or empty vector, or one
with null or non-finite components take no part; vectors of different lengths
aren't compared; repeated rows count once; rows that share the anchor's id are no
candidates; an anchor id that repeats is asked once, with its least (length,
label, vector); equal scores go to the smaller id; a positive with a negative
score has an empty window, one with score 0 that of score 0; anchors without
positives or without negatives in the windows have no rows; empty tables give an
empty result; extra columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, slices
from coopspark.llm.topk import finite
from coopspark.plans.stage import split_count, written

BLOCK_ROWS = 65_536
ASKED = 16_384
CELLS = 4_000_000
_SIGN = 1 << 63
_MOST = _SIGN - 1
KEY = struct.Struct(">QQBQ")
BLOCK = ["dim", "block", "part"]


def rows_of(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, v) of the distinct rows that take part, v in the narrowest integers that hold all."""
    own = columns_of(vectors, id_col, vector_col, label_col).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("x"))
    own = own.where(finite(F.col("x")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    whole = own.select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda x: F.floor(F.lit(scale) * x)).alias("v"))
    top = whole.agg(F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, -1 - x))))).first()[0]
    kind = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if (top or 0) < 2**bits)
    return written(whole.withColumn("v", F.col("v").cast(f"array<{kind}>")).distinct())


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


class Block:
    """The rows of one block in the order of their ids, and scores of anchors against them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.lexsort((labels, ids))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.top = _largest(self.rows)
        self.cast: dict = {}
        # Of two equal scores the earlier row is the better one.
        self.place = np.arange(len(ids))[::-1]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, exact: whole numbers as doubles, or as Python integers where 53 bits don't hold score and place."""
        most = _largest(anchors) * self.top * self.rows.shape[1]
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
        if kind not in self.cast:
            self.cast = {kind: self.rows.astype(kind).T}
        out = anchors.astype(kind) @ self.cast[kind]
        wide = 100 * most * (len(self.ids) + 1) >= 2**53
        return np.array([[int(v) for v in row] for row in out], object).reshape(out.shape) if wide else out.astype(np.float64)

    def best(self, scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) of the k best allowed rows of each anchor."""
        r = len(self.ids)
        few = min(k, r)
        if scores.dtype == object:
            ranked = [[j for j in sorted(np.flatnonzero(ok).tolist(), key=lambda j: (-line[j], j))[:k]] for line, ok in zip(scores, allowed, strict=True)]
            return np.repeat(np.arange(len(scores)), [len(x) for x in ranked]), np.array([j for x in ranked for j in x], np.int64)
        key = np.where(allowed, scores * r + self.place, -np.inf)
        at = np.argpartition(key, r - few, axis=1)[:, r - few :] if few < r else np.tile(np.arange(r), (len(scores), 1))
        i, j = np.nonzero(np.take_along_axis(allowed, at, axis=1))
        return i, at[i, j]


def _narrow(score) -> int:
    return max(-_MOST, min(_MOST, int(score)))


def _found(anchors: np.ndarray, block: Block, scores: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    got = scores[i, j]
    s = pa.array([_narrow(v) for v in got], pa.int64()) if got.dtype == object else pa.array(got.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(anchors[i]), s, pa.array(block.ids[j])], names=["anchor_id", "score", "vec_id"])


def _against(choose: Callable[[Block, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (dim, block, part, asks, vec_id, label, v, windows) sorted by (block, asks): a block's rows, then its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in slices(batches, 512):
            keys = np.stack([batch.column(c).cast(pa.int64()).to_numpy() for c in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (now := tuple(keys[:3, a].tolist())) != at:
                    at, held, block = now, [], None
                part = batch.slice(a, b - a)
                x = part.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, now[0])
                own = (part.column(4).to_numpy(), part.column(5).to_numpy(), x)
                if not keys[3, a]:
                    held.append(own)
                    continue
                if block is None:
                    block, held = Block(*[np.concatenate([h[c] for h in held]) for c in range(3)]), []
                step = max(1, CELLS // len(block.ids))
                for f in range(0, len(x), step):
                    names, labels, v = own[0][f : f + step], own[1][f : f + step], x[f : f + step]
                    scores = block.scores(v)
                    i, j = choose(block, names, labels, scores, part.slice(f, len(names)))
                    if len(i):
                        yield _found(names, block, scores, i, j)

    return run


def _own_label(k: int) -> Callable:
    """Each anchor's k best rows of its label."""

    def choose(block: Block, names: np.ndarray, labels: np.ndarray, scores: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return block.best(scores, (labels[:, None] == block.labels) & (names[:, None] != block.ids), k)

    return choose


def _in_windows(k: int, low: int, high: int) -> Callable:
    """Each anchor's k best rows of another label in each window of its positives."""

    def choose(block: Block, names: np.ndarray, labels: np.ndarray, scores: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        other = (labels[:, None] != block.labels) & (names[:, None] != block.ids)
        windows = part.column(7).to_pylist()
        found = []
        for w in range(max(map(len, windows))):
            there = np.array([w < len(x) for x in windows])
            p = np.array([x[w] if w < len(x) else 0 for x in windows], scores.dtype)[:, None]
            inside = other & there[:, None] & (low * p <= 100 * scores) & (100 * scores <= high * p)
            found.append(np.stack(block.best(scores, inside.astype(bool), k)))
        i, j = np.unique(np.concatenate(found, axis=1), axis=1)
        return i, j

    return choose


def _dealt(rows: DataFrame, anchors: DataFrame, n: int, asked: int, block_rows: int) -> DataFrame:
    """Blocks of rows with the anchors to put to them, ready for ``_against``; anchors are (vec_id, label, dim, v, windows)."""
    parts = split_count(rows)
    blocks = max(-(-n // block_rows), min(parts, -(-n // 1024)), 1)
    copies = max(1, -(-asked // ASKED))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)).cast("int").alias("block")
    held = rows.select("dim", place, numbers(copies).alias("part"), F.lit(0).alias("asks"), "vec_id", "label", "v", F.lit(None).cast("array<bigint>").alias("windows"))
    # Anchors go only to blocks that have rows of their length.
    there = held.select("dim", "block", "part").distinct()
    asks = anchors.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(copies)).cast("int")).join(there, ["dim", "part"])
    asks = asks.select("dim", "block", "part", F.lit(1).alias("asks"), "vec_id", "label", "v", "windows")
    return held.unionByName(asks).repartition(parts, *BLOCK).sortWithinPartitions(*BLOCK, "asks")


def pack(anchor: int, score: int, positive: bool, vec_id: int) -> bytes:
    """A key whose bytes sort by anchor, falling score, positives first, id."""
    return KEY.pack(anchor + _SIGN, _MOST - score, 0 if positive else 1, vec_id + _SIGN)


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    a, s, other, i = KEY.unpack(key)
    return a - _SIGN, _MOST - s, not other, i - _SIGN


def windows(keys: Iterator[bytes], negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive's score, negative's score) from keys in their order."""
    at, open_ = None, []
    for key in keys:
        anchor, score, positive, vec_id = unpack(key)
        if anchor != at:
            at, open_ = anchor, []
        if positive:
            open_.append([vec_id, score, 0])
            continue
        open_ = [w for w in open_ if w[2] < negatives and low * w[1] <= 100 * score]
        for w in open_:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], vec_id, w[1], score


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows where ``is_anchor`` (of vec_id). A positive's window
    holds the scores s with ``low * p <= 100 * s <= high * p``.
    """
    if positives < 1 or negatives < 1:
        raise ValueError("positives and negatives must be positive")
    rows = rows_of(vectors, scale, id_col, vector_col, label_col)
    least = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("dim", "label", "v")).alias("a"))
    anchors = written(least.select("vec_id", "a.label", "a.dim", "a.v"))
    n, asked = rows.count(), anchors.count()
    schema = "anchor_id bigint, score bigint, vec_id bigint"
    own = _dealt(rows, anchors.withColumn("windows", F.lit(None).cast("array<bigint>")), n, asked, block_rows).mapInArrow(_against(_own_label(positives)), schema)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    own = written(own.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives).drop("at"))
    limits = own.groupBy("anchor_id").agg(F.collect_list("score").alias("windows"))  # ``positives`` entries at most
    with_windows = anchors.join(limits, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    others = _dealt(rows, with_windows, n, asked, block_rows).mapInArrow(_against(_in_windows(negatives, low, high)), schema)
    scored = own.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    keys = scored.rdd.map(lambda r: (pack(r.anchor_id, r.score, r.positive, r.vec_id), None))
    dealt = keys.repartitionAndSortWithinPartitions(split_count(rows), lambda key: zlib.crc32(key[:8]))
    mined = dealt.mapPartitions(lambda part: windows((key for key, _ in part), negatives, low, high))
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return rows.sparkSession.createDataFrame(mined, out, verifySchema=False)
