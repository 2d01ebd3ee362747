"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

Vectors are dealt to the nearest of at most ``CENTRES`` coarse centres of their
length, and a centre's cell to shards of about ``shard_rows`` by a hash of the
id. A task builds the ball tree of a shard (centre, radius, leaves of ``LEAF``
rows) and then streams queries through it: a node's inner products are at most
``q . centre + |q| radius``; nodes are visited in falling order of that bound and
the search stops below the current k-th score. That score is shared: a first
pass searches one shard of each query's own cell, and the k-th scores that it
finds are the starting bounds of all others. A cell has the same bound as a
node, so a query goes only to the shards of cells whose bound reaches its k-th
score. Queries reach the shards as rows in the shards' partitions; a shard that
many queries reach is copied for each ``ASKED`` of them, so that a task holds
one shard and a bounded batch of queries. Only the centres (at most ``CENTRES``
vectors) and the cells' radii pass through the driver.

Scores are integers (vectors are integer-valued) and exact: in double precision
while sums stay below 2**53, else in Python's integers (clipped to 64 bits in
the result).

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part; vectors of different length aren't compared; equal
scores go to the smaller id; vectors of a length that no centre has are one
cell without a bound, which every query of that length visits; repeated rows of a query's id are other candidates
only under another id (every row with the query's own id is left out), and a
query id that repeats is asked once, with its least vector; fewer candidates
than k give fewer rows; empty tables give an empty result; extra columns are
not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, slices
from coopspark.plans.stage import split_count, written

SHARD_ROWS = 16_384
CENTRES = 256
ASKED = 65_536
LEAF = 64
_MOST = 2**63 - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its components are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))), F.lit(False))


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of the vectors that take part."""
    own = columns_of(vectors, id_col, vector_col).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("x"))
    return own.where(finite(F.col("x")) & F.col("vec_id").isNotNull()).select("vec_id", F.transform("x", lambda x: F.floor(F.lit(scale) * x)).alias("v"))


class BallTree:
    """Nodes over the rows of one shard; children halve a node across its widest direction."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.exact = rows.dtype != object
        self.ids, self.rows = ids, rows
        approx = rows.astype(np.float64)
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left, right (-1: a leaf)
        centres, radii = [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            at = len(self.nodes)
            x = approx[order[a:b]]
            centre = x.mean(axis=0)
            gap = np.sqrt(((x - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(gap.max())
            self.nodes.append((a, b, -1, -1))
            if parent >= 0:
                f, t, left, right = self.nodes[parent]
                self.nodes[parent] = (f, t, at, right) if side == 0 else (f, t, left, at)
            if b - a > leaf and radii[-1] > 0:
                far = x[gap.argmax()]
                other = x[((x - far) ** 2).sum(axis=1).argmax()]
                place = np.argsort(x @ (other - far), kind="stable")
                order[a:b] = order[a:b][place]
                middle = (a + b) // 2
                todo += [(middle, b, at, 1), (a, middle, at, 0)]
        self.ids, self.rows = ids[order], rows[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, one row for each query; a relative margin covers rounding."""
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))[:, None]
        reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        return q @ self.centres.T + norms * self.radii + 1e-9 * (1 + norms * reach)

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id), not counting rows that score below ``least``."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        floor = -np.inf if least is None else least
        while heap:
            bound, at = heapq.heappop(heap)
            if -bound < floor:
                break
            a, b, left, right = self.nodes[at]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            scores = self.rows[a:b] @ query
            for i in np.flatnonzero(scores >= floor).tolist():
                if (own := int(self.ids[a + i])) != query_id:
                    item = (int(scores[i]), -own)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


SHARD = ["dim", "cell", "salt"]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A list column whose rows all have ``dim`` entries, as 64-bit integers."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _largest(rows: np.ndarray) -> float:
    return float(np.abs(rows.astype(np.float64)).max(initial=0.0))


def _numbers(rows: np.ndarray) -> np.ndarray:
    """Doubles if all sums of products are exact in them, else Python integers."""
    return rows.astype(np.float64) if _largest(rows) ** 2 * rows.shape[1] < 2**53 else rows.astype(object)


def _alike(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ends of the runs of rows that agree in all columns."""
    table = np.stack(columns)
    cuts = np.flatnonzero((table[:, 1:] != table[:, :-1]).any(axis=0)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), table.shape[1]], strict=True)


def _assign(centres: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds each vector's cell (the nearest centre of its length, else -1) and its distance from that centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            dims = batch.column(1).to_numpy()
            cell, gap = np.full(len(dims), -1, np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                if d in centres:
                    numbers, c = centres[d]
                    at = np.flatnonzero(dims == d)
                    x = _matrix(batch.column(2).take(pa.array(at)), d).astype(np.float64)
                    best = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
                    cell[at] = numbers[best]
                    gap[at] = np.sqrt(((x - c[best]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(gap)], names=[*batch.schema.names, "cell", "gap"])

    return run


def _reach(centres: dict[int, tuple[np.ndarray, np.ndarray]], radii: dict[int, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(dim, v, vec_id, least, home, own) once for each cell whose inner products can reach ``least``, with that cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            dims = batch.column(0).to_numpy()
            least = batch.column(3).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy()
            rows, cells = [], []
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if d not in centres:
                    rows.append(at)
                    cells.append(np.full(len(at), -1, np.int64))
                    continue
                numbers, c = centres[d]
                r = np.array([radii.get(n, 0.0) for n in numbers.tolist()])
                q = _matrix(batch.column(1).take(pa.array(at)), d).astype(np.float64)
                norms = np.sqrt((q * q).sum(axis=1))[:, None]
                bound = q @ c.T + norms * r + 1e-9 * (1 + norms * (np.sqrt((c * c).sum(axis=1)) + r))
                i, j = np.nonzero(bound >= least[at][:, None])
                rows.append(at[i])
                cells.append(numbers[j])
            if rows:
                taken = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cells))], names=[*batch.schema.names, "cell"])

    return run


def _scan(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (shard and copy, is a query): a shard's vectors, then the queries to put to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, tree = None, [], [], None
        for batch in slices(batches, 512):
            keys = [batch.column(c).to_numpy() for c in range(4)]
            asks = batch.column(4).to_numpy(zero_copy_only=False)
            found: list[tuple[int, int, int]] = []
            for a, b in _alike(*keys, asks):
                if (own := tuple(int(c[a]) for c in keys)) != shard:
                    shard, ids, rows, tree = own, [], [], None
                part = batch.slice(a, b - a)
                names, x = part.column(5).to_numpy(), _matrix(part.column(6), shard[0])
                if not asks[a]:
                    ids.append(names)
                    rows.append(x)
                    continue
                if tree is None:
                    tree, ids, rows = BallTree(np.concatenate(ids), _numbers(np.concatenate(rows))), [], []
                q = _numbers(x)
                if q.dtype == object or tree.rows.dtype == object or _largest(q) * _largest(tree.rows) * shard[0] >= 2**53:
                    q = x.astype(object)
                    if tree.rows.dtype != object:
                        tree.rows = tree.rows.astype(np.int64).astype(object)
                for one, query, bound, least in zip(names.tolist(), q, tree.bounds(q), part.column(7).to_pylist(), strict=True):
                    found += [(one, -i, max(-_MOST, min(_MOST, s))) for s, i in tree.search(one, query, bound, k, least)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def _narrow(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vectors`` with the narrowest integers that hold all components, and the number of rows."""
    size = F.array_max(F.transform("v", lambda x: F.greatest(x, -1 - x)))
    n, top = vectors.agg(F.count(F.lit(1)), F.max(size)).first()
    kind = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if (top or 0) < 2**bits)
    return vectors.withColumn("v", F.col("v").cast(f"array<{kind}>")), n


class Shards:
    """The vectors in cells and shards, and where queries go."""

    def __init__(self, vectors: DataFrame, is_query: Column, shard_rows: int):
        self.parts = split_count(vectors)
        all_, n = _narrow(vectors)
        # At least as many cells as keep the partitions busy; shards then hold fewer rows.
        cells = min(CENTRES, max(-(-n // shard_rows), min(self.parts, -(-n // 1024))))
        drawn = all_.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "v").limit(cells).select("dim", "v").distinct().collect()  # at most CENTRES vectors
        by_dim: dict[int, list[tuple[int, list[int]]]] = {}
        for number, r in enumerate(drawn):
            by_dim.setdefault(r.dim, []).append((number, r.v))
        self.centres = {d: (np.array([i for i, _ in own]), np.array([v for _, v in own], np.float64)) for d, own in by_dim.items()}
        kind = all_.schema["v"].dataType.simpleString()
        placed = all_.select("vec_id", "dim", "v").mapInArrow(_assign(self.centres), f"vec_id bigint, dim int, v {kind}, cell bigint, gap double")
        self.placed = written(placed)
        cells_of = self.placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).alias("salts"), F.max("gap").alias("radius"))
        self.cells = written(cells_of)
        radii = self.cells.where("cell >= 0").select("cell", "radius").collect()  # one row a centre
        self.radii = {r.cell: r.radius for r in radii}
        salt = lambda seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("salts"))
        own = self.placed.join(self.cells.select("dim", "cell", "salts"), ["dim", "cell"])
        self.rows = own.select(*SHARD[:2], salt(1).alias("salt"), "vec_id", "v")
        queries = own.where(is_query).groupBy("vec_id", "dim").agg(F.min(F.struct("v", "cell", "salts")).alias("q"))
        self.queries = queries.select("dim", "q.cell", "q.salts", "vec_id", "q.v").select(*SHARD[:2], salt(7).alias("salt"), "vec_id", "v")

    def others(self, kth: DataFrame) -> DataFrame:
        """(dim, cell, salt, vec_id, v, least): each query at every further shard that its k-th score doesn't exclude; ``kth`` is (query_id, least)."""
        asked = self.queries.join(kth, F.col("query_id") == F.col("vec_id"), "left").select("dim", "v", "vec_id", "least", F.col("cell").alias("home"), F.col("salt").alias("own"))
        kind = asked.schema["v"].dataType.simpleString()
        reached = asked.mapInArrow(_reach(self.centres, self.radii), f"dim int, v {kind}, vec_id bigint, least bigint, home bigint, own bigint, cell bigint")
        each = reached.join(self.cells.select("dim", "cell", "salts"), ["dim", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        return each.where((F.col("cell") != F.col("home")) | (F.col("salt") != F.col("own"))).select(*SHARD, "vec_id", "v", "least")

    def put(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the k best of each asked shard."""
        blocks = asked.groupBy(*SHARD).agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED)).alias("blocks"))
        none = F.lit(None).cast("bigint").alias("least")
        held = self.rows.join(blocks, SHARD).select(*SHARD, "blocks", "vec_id", "v").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held = held.select(*SHARD, "copy", F.lit(False).alias("asks"), "vec_id", "v", none)
        put = asked.join(blocks, SHARD).select(*SHARD, F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("blocks")).alias("copy"), F.lit(True).alias("asks"), "vec_id", "v", "least")
        keys = [*SHARD, "copy"]
        work = held.unionByName(put).repartition(self.parts, *keys).sortWithinPartitions(*keys, "asks")
        return work.mapInArrow(_scan(k), "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` where ``is_query`` (of vec_id), the k best others."""
    if k < 1:
        raise ValueError("k must be positive")
    all_ = written(quantised(vectors, scale, id_col, vector_col).distinct().withColumn("dim", F.size("v")))
    shards = Shards(all_, is_query, shard_rows)
    first = written(shards.put(shards.queries.withColumn("least", F.lit(None).cast("bigint")), k))
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).select("query_id", F.when(F.col("n") >= k, F.col("low")).alias("least"))
    rest = shards.put(shards.others(kth), k)
    return _best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
