"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Vectors that are equal are one node, so a vector with very many copies neither
fills neighbour lists nor any task; the copies' ids join again at the end.

*Build.* Each node starts with neighbours from ``TREES`` random projections: the
nodes are sorted along a projection within cells of a coarser one and meet the
next ones in that order (blocks of ``cell`` to 2 ``cell`` - 1, so that every node
starts with ``degree`` neighbours if there are as many). Then each round joins, around
every node, its neighbours and reverse neighbours with each other (neighbours of
neighbours), where at least one is new, and keeps each node's ``degree`` nearest;
every pair that can enter one of the two lists goes on. Reverse lists are
sampled by hash to ``degree``, as the method does. Rounds end when under
``SETTLED`` of all entries change, after ``rounds`` at most.

The centres of a *home*, a run of the first projection's order, are joined in
one task. As they share most of their neighbours, a vector goes there once for
all of them, not once for each edge: there are ``HOMES`` homes, more only where
one would have over ``HOME`` nodes, and a round never sends more than
``2 degree`` vectors a node. The build works on
single-precision copies of the centred vectors, each with its own exponent.

*Search.* A query needs not be in the graph: it enters at the ``STARTS`` nearest
of at most ``ENTRIES`` nodes, drawn by hash. Walks use the graph, its reverse and
a few random links. All queries walk together: a round expands each query's
``expand`` nearest unexpanded nodes (an equi-join with the graph), measures the
neighbours that it hasn't met before and keeps the ``beam`` nearest; it ends when
no query has one left. Distances are Euclidean in double precision on the
original vectors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of different length aren't compared, and each
length has a graph of its own; ties go to the smaller id; rows with the query's own id are left out; repeated
rows count once; empty tables give an empty result; extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.llm.common import columns_of, slices
from coopspark.llm.topk import finite
from coopspark.operators.running import running_sum
from coopspark.plans.stage import split_count, written

DEGREE, ROUNDS, BEAM, EXPAND = 40, 8, 64, 16
LINKS, BACK_LINKS = 24, 16
ENTRIES, STARTS = 512, 16
SEEN_TABLES = 12
TREES, CELL = 4, 256
HOMES, HOME = 16, 4096  # homes at least, nodes of a home at most
SETTLED = 0.02
HIGHEST = 480  # exponent of the largest component of the copies


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part, in double precision; repeated rows once."""
    own = columns_of(vectors, id_col, vector_col).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(F.col(vector_col), lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
    return written(own.where(finite(F.col("x")) & F.col("vec_id").isNotNull() & F.exists("x", lambda v: v != 0)).distinct())


def nodes_of(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors, (node, x), and all rows, (vec_id, node); a node is named by its least id."""
    nodes = written(own.groupBy("x").agg(F.min("vec_id").alias("node")).select("node", "x"))
    members = own.join(nodes, "x").select("vec_id", "node")
    return nodes, written(members)


def _vectors(column: pa.Array) -> np.ndarray:
    """The copies that ``_scaled`` packed, in double precision."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)
    return np.ldexp(raw[:, 1:].astype(np.float64), raw[:, :1].view(np.int32))


def _scaled(nodes: DataFrame) -> DataFrame:
    """(node, h): an exponent of the vector's own and single-precision fractions of it, as bytes.

    Vectors are taken from the components' medians. One power of two for all puts
    the largest component where its square is still a double; vectors that are up
    to 1e300 times smaller keep their precision.
    """
    length = nodes.select(F.size("x")).first()
    top = nodes.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()[0] or 1.0
    shift = HIGHEST - int(np.frexp(top)[1])
    medians = nodes.agg(*[F.percentile_approx(F.element_at("x", i + 1), 0.5, 200) for i in range(length[0])]).first() if length else []
    middle = np.ldexp(np.array(medians, np.float64), shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x = np.ldexp(np.array(batch.column(1).to_pylist(), np.float64), shift) - middle
            own = np.frexp(np.abs(x).max(axis=1, keepdims=True))[1].astype(np.int32)
            data = np.hstack([own.view(np.float32), np.ldexp(x, -own).astype(np.float32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in data], pa.binary())], names=["node", "h"])

    return written(nodes.select("node", "x").mapInArrow(run, "node bigint, h binary"))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k nearest other rows: positions from, positions to, squared distances."""
    n, k = len(ids), min(k, len(ids) - 1)
    if k < 1:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    sq = (x * x).sum(axis=1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    to = np.argpartition(d, k - 1, axis=1)[:, :k]
    at = np.repeat(np.arange(n), k)
    return at, to.ravel(), d[at, to.ravel()]


def _start(degree: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, node, h) sorted by block: the vectors of a block are compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, own = [], [], None

        def block() -> pa.RecordBatch:
            members = np.array(ids, np.int64)
            at, to, d = _nearest(members, np.stack(rows), degree)
            return pa.RecordBatch.from_arrays([pa.array(members[at]), pa.array(members[to]), pa.array(d)], names=["u", "v", "d"])

        for batch in slices(batches, 256):
            x = _vectors(batch.column(2))
            for b, node, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), x, strict=True):
                if ids and b != own:
                    yield block()
                    ids, rows = [], []
                own = b
                ids.append(node)
                rows.append(row)
        if ids:
            yield block()

    return run


def _planes(half: DataFrame, trees: int, cells: int) -> DataFrame:
    """(tree, cell, place, node): for each tree, a cell by the signs of some random planes and a place along another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            x = _vectors(batch.column(1))
            for t in range(trees):
                planes = np.random.default_rng(1000 + t).standard_normal((1 + cells, x.shape[1]))
                p = x @ planes.T
                cell = ((p[:, 1:] > 0) << np.arange(cells)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(cell, pa.int64()), pa.array(p[:, 0]), batch.column(0)], names=["tree", "cell", "place", "node"])

    return half.mapInArrow(run, "tree bigint, cell bigint, place double, node bigint")


def _ordered(half: DataFrame, trees: int, cells: int) -> DataFrame:
    """(tree, at, node): each tree's order of all nodes, numbered from 0.

    The order goes through the cells one after the other, so that however few
    nodes a sign cell has, they meet those of the next ones.
    """
    placed = _planes(half, trees, cells).withColumn("one", F.lit(1))
    numbered = running_sum(placed, "one", ["cell", "place", "node"], ["tree"], name="at", rows=True)
    return written(numbered.select("tree", (F.col("at") - 1).alias("at"), "node"))


def _keep(edges: DataFrame, degree: int) -> DataFrame:
    """Each node's nearest ``degree`` entries; an edge known before stays marked as old."""
    one = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"), F.first("hu").alias("hu"), F.first("hv").alias("hv"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return one.withColumn("place", place).where(F.col("place") <= degree).drop("place")


def _nearest_of_each(u: np.ndarray, v: np.ndarray, d: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each u's ``degree`` nearest different v: no other can be among its nearest of all tasks."""
    order = np.lexsort((d, v, u))
    u, v, d = u[order], v[order], d[order]
    one = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(u)]
    u, v, d = u[one], v[one], d[one]
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    keep = np.arange(len(u)) - np.searchsorted(u, u) < degree
    return u[keep], v[keep], d[keep]


def _join_around(degree: int, at_once: int = 128, hold: int = 1_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (home, c, node, new, far, hn, h) sorted by (home, c), of which those without c bring the vectors: all pairs around a centre with a new one are measured.

    A pair goes on to each end whose list it can enter, that is, unless it is
    farther than ``far``, the end's worst entry. Of what a home has found for a
    node, its ``degree`` nearest leave it.
    """

    def joined(ids: np.ndarray, far: np.ndarray, homes: np.ndarray, x: np.ndarray, c: np.ndarray, node: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids)
        ids, far, homes, x = ids[order], far[order], homes[order], x[order]
        sq, place = (x * x).sum(axis=1), np.searchsorted(ids, node)
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(c)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo in range(0, len(starts), at_once):
            first, n = starts[lo : lo + at_once], sizes[lo : lo + at_once]
            within = np.arange(n.max())[None, :] < n[:, None]
            rows = np.where(within, first[:, None] + np.arange(n.max())[None, :], 0)
            at, fresh = place[rows], new[rows] & within
            some = x[at]
            d = np.maximum(sq[at][:, :, None] + sq[at][:, None, :] - 2 * (some @ some.transpose(0, 2, 1)), 0)
            enters = (fresh[:, :, None] | fresh[:, None, :]) & within[:, :, None] & within[:, None, :] & (d <= far[at][:, :, None])
            enters[:, np.arange(n.max()), np.arange(n.max())] = False
            b, i, j = np.nonzero(enters)
            found.append((at[b, i], at[b, j], d[b, i, j]))
            if sum(len(part[0]) for part in found) > hold:
                found = [_nearest_of_each(*(np.concatenate([part[k] for part in found]) for k in range(3)), degree)]
        u, v, d = _nearest_of_each(*(np.concatenate([part[k] for part in found]) for k in range(3)), degree)
        return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v]), pa.array(d), pa.array(homes[u]), pa.array(homes[v])], names=["u", "v", "d", "hu", "hv"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = None
        vectors: list[tuple[np.ndarray, ...]] = []
        edges: list[tuple[np.ndarray, ...]] = []

        def done() -> pa.RecordBatch:
            return joined(*(np.concatenate([part[k] for part in vectors]) for k in range(4)), *(np.concatenate([part[k] for part in edges]) for k in range(3)))

        for whole in batches:
            place = whole.column(0).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi == lo:
                    continue
                if place[lo] != home:
                    if edges:
                        yield done()
                    home, vectors, edges = place[lo], [], []
                batch = whole.slice(lo, hi - lo)
                brings = batch.column(1).is_null()
                for rows, held in ((batch.filter(brings), vectors), (batch.filter(pc.invert(brings)), edges)):
                    if rows.num_rows and held is vectors:
                        held.append((*(rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 4, 5)), _vectors(rows.column(6))))
                    elif rows.num_rows:
                        held.append(tuple(rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)))
        if edges:
            yield done()

    return run


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, trees: int = TREES, cell: int = CELL) -> DataFrame:
    """(u, v, d): each node's approximate nearest neighbours, with squared distances of the scaled copies."""
    half, parts = _scaled(nodes), split_count(nodes)
    n = half.count()
    cells = max(0, min(20, int(np.log2(max(1, n / (4 * cell))))))
    ordered = _ordered(half, trees, cells)
    home = min(HOME, -(-n // HOMES)) or 1
    homes = ordered.where("tree = 0").select("node", F.expr(f"at div {home}").alias("hn"))
    half = written(half.join(homes, "node").select("node", "hn", "h"))
    last = max(1, n // cell) - 1
    block = F.least(F.expr(f"at div {cell}"), F.lit(last)) * trees + F.col("tree")
    blocks = ordered.select(block.alias("block"), "node").join(half.select("node", "h"), "node").select("block", "node", "h")
    started = blocks.repartition(parts, "block").sortWithinPartitions("block", "node").mapInArrow(_start(degree), "u bigint, v bigint, d double")
    home_of = half.select(F.col("node").alias("v"), F.col("hn").alias("hv"))
    started = started.join(home_of, "v").join(home_of.toDF("u", "hu"), "u")
    edges = written(_keep(started.withColumn("new", F.lit(1)), degree))
    for _ in range(rounds):
        back = edges.select(F.col("hv").alias("home"), F.col("v").alias("c"), F.col("u").alias("node"), "new")
        some = Window.partitionBy("c").orderBy(F.desc("new"), F.xxhash64("node", "c"))
        back = back.withColumn("place", F.row_number().over(some)).where(F.col("place") <= degree).drop("place")
        around = edges.select(F.col("hu").alias("home"), F.col("u").alias("c"), F.col("v").alias("node"), "new").unionByName(back)
        around = written(around.groupBy("home", "c", "node").agg(F.max("new").alias("new")))
        worst = edges.groupBy("u").agg(F.when(F.count(F.lit(1)) >= degree, F.max("d")).alias("far")).withColumnRenamed("u", "node")
        far = F.coalesce("far", F.lit(float("inf"))).alias("far")
        vectors = around.select("home", "node").distinct().join(half, "node").join(worst, "node", "left")
        vectors = vectors.select("home", F.lit(None).cast("bigint").alias("c"), "node", F.lit(None).cast("boolean").alias("new"), far, "hn", "h")
        none = [F.lit(None).cast(t).alias(name) for name, t in (("far", "double"), ("hn", "bigint"), ("h", "binary"))]
        work = vectors.unionByName(around.select("home", "c", "node", (F.col("new") == 1).alias("new"), *none))
        found = work.repartition(parts, "home").sortWithinPartitions("home", "c").mapInArrow(_join_around(degree), "u bigint, v bigint, d double, hu bigint, hv bigint")
        known = edges.withColumn("new", F.lit(0))
        edges = written(_keep(known.unionByName(found.withColumn("new", F.lit(1))), degree))
        if edges.where("new = 1").count() < SETTLED * degree * n:
            break
    return edges.select("u", "v", "d")


def both_ways(graph: DataFrame, links: int = LINKS, back_links: int = BACK_LINKS) -> DataFrame:
    """(u, v): what walks follow: each node's ``links`` nearest, and the ``back_links`` nearest of those that it is a neighbour of."""
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    out = graph.withColumn("place", place).where(F.col("place") <= links).select("u", "v")
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "d").withColumn("place", place).where(F.col("place") <= back_links).select("u", "v")
    return written(out.unionByName(back).distinct())


def random_links(nodes: DataFrame, rings: int = 2) -> DataFrame:
    """(u, v): each node's next and previous ones on rings in random order, by which groups that are far from each other stay within reach."""
    ends = [nodes.select("node", F.xxhash64("node", F.lit(r)).alias("place"), F.lit(r).alias("ring"), F.lit(1).alias("one")) for r in range(rings)]
    order = written(running_sum(reduce(DataFrame.unionByName, ends), "one", ["place", "node"], ["ring"], name="at", rows=True).select("ring", "node", "at"))
    after = order.select("ring", F.col("node").alias("v"), (F.col("at") - 1).alias("at"))
    # The last one's next is the first.
    n = nodes.count()
    after = after.withColumn("at", F.when(F.col("at") == 0, F.lit(n)).otherwise(F.col("at")))
    links = order.withColumnRenamed("node", "u").join(after, ["ring", "at"]).where("u <> v").select("u", "v")
    return written(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))


def _numbers(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed in the order of the components."""
    return np.sqrt(np.add.accumulate((q - x) ** 2, axis=1)[:, -1])


def entries_of(nodes: DataFrame, most: int = ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Entry nodes of the graph, drawn by hash: at most ``most``, and no more than the square root of their number asks for."""
    wanted = min(most, 2 * int(np.ceil(np.sqrt(nodes.count()))))
    rows = nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(wanted).collect()
    return np.array([r.node for r in rows], np.int64), np.array([r.x for r in rows], np.float64)


def _entered(ids: np.ndarray, x: np.ndarray, starts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (query, x): each query's nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            d = np.stack([_distances(q[None, :], x) for q in _numbers(batch.column(1))])
            at = np.argsort(d, axis=1, kind="stable")[:, :starts]
            query = np.repeat(batch.column(0).to_numpy(), at.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(d, at, 1).ravel())], names=["query", "node", "d"])

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, node, x) sorted by (query, node), of which the one without a node is the query's own vector: (query, node, d)."""
    query, own = None, None
    for batch in slices(batches, 4096):
        q, nodes, x = batch.column(0).to_numpy(), pc.fill_null(batch.column(1), 0).to_numpy(), _numbers(batch.column(2))
        bounds = [0, *(np.flatnonzero(np.diff(q)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if q[lo] != query:
                query, own, lo = q[lo], x[lo], lo + 1
            if hi > lo:
                yield pa.RecordBatch.from_arrays([pa.array(q[lo:hi]), pa.array(nodes[lo:hi]), pa.array(_distances(own[None, :], x[lo:hi]))], names=["query", "node", "d"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, expand: int = EXPAND, starts: int = STARTS, seen_out: list[DataFrame] | None = None) -> DataFrame:
    """(query, node, d): for queries (query, x), the ``beam`` nearest nodes that a greedy walk finds.

    ``seen_out`` receives the table of all (query, node) whose distance was taken,
    besides the entries'.
    """
    ids, x = entries_of(nodes)
    if not len(ids):
        return nodes.sparkSession.createDataFrame([], "query bigint, node bigint, d double")
    asked, parts = written(queries.select("query", "x")), split_count(nodes)
    pool = asked.mapInArrow(_entered(ids, x, starts), "query bigint, node bigint, d double").withColumn("done", F.lit(False))
    seen = [written(pool.select("query", "node"))]
    order = Window.partitionBy("query").orderBy("d", "node")
    todo = Window.partitionBy("query", "done").orderBy("d", "node")
    while True:
        # Ranks among all and among those not expanded yet; both windows follow one shuffle by query.
        pool = pool.withColumn("place", F.row_number().over(order)).where(F.col("place") <= beam)
        now = ~F.col("done") & (F.row_number().over(todo) <= expand)
        pool = written(pool.withColumn("now", now).select("query", "node", "d", "done", "now"))
        met = reduce(DataFrame.unionByName, seen)
        if len(seen) > SEEN_TABLES:
            seen = [met := written(met)]
        near = pool.where("now").join(graph, F.col("node") == F.col("u")).select("query", F.col("v").alias("node")).distinct()
        near = written(near.join(met, ["query", "node"], "left_anti"))
        if near.isEmpty():
            if pool.where("now").isEmpty():
                break
            pool = pool.select("query", "node", "d", (F.col("done") | F.col("now")).alias("done"))
            continue
        vectors = near.join(nodes, "node").select("query", "node", "x")
        work = vectors.unionByName(asked.select("query", F.lit(None).cast("bigint").alias("node"), "x"))
        fresh = work.repartition(parts, "query").sortWithinPartitions("query", F.col("node").asc_nulls_first()).mapInArrow(_measured, "query bigint, node bigint, d double")
        pool = pool.select("query", "node", "d", (F.col("done") | F.col("now")).alias("done")).unionByName(fresh.withColumn("done", F.lit(False)))
        seen.append(near)
    if seen_out is not None:
        seen_out.append(reduce(DataFrame.unionByName, seen))
    return pool.select("query", "node", "d")


def _nearest_alike(own: DataFrame, is_query: Column, k: int, degree: int, beam: int) -> DataFrame:
    """``nearest`` among vectors of one length."""
    nodes, members = nodes_of(own)
    degree = max(degree, k)
    graph = written(both_ways(build_graph(nodes, degree), max(LINKS, k)).unionByName(random_links(nodes)).distinct())
    asking = members.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("from"))
    walks = asking.select(F.col("from").alias("query")).distinct().join(nodes, F.col("query") == F.col("node")).select("query", "x")
    found = search(nodes, graph, walks, max(beam, k + 1))
    # A node stands for all its copies; no query needs more than k + 1 of them.
    few = members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    answers = asking.join(found, F.col("from") == F.col("query")).select("query_id", "node", "d").join(few, "node").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, degree: int = DEGREE, beam: int = BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (of vec_id), its k nearest others as found."""
    own = usable(vectors, id_col, vector_col)
    lengths = [r.d for r in own.select(F.size("x").alias("d")).distinct().collect()]  # as many as there are kinds of vectors
    each = [_nearest_alike(own.where(F.size("x") == d), is_query, k, degree, beam) for d in sorted(lengths)]
    empty = own.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return reduce(DataFrame.unionByName, each) if each else empty
