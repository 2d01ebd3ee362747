"""Exact top-k against SQL and brute force; neighbours by recall against brute force."""

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from coopspark.llm import ann, queries, topk


def odd_vectors(seed=3, n=400, d=6):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, d)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(60)]  # many copies of a query's vector
    rows += [(50, rows[50][1]), (2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * d), (2150, [float("inf")] + [0.0] * (d - 1)), (2200, [0.0] * d), (2250, []), (2300, [1.0, 2.0]), (None, [1.0] * d), (2350, [1e6] * d)]
    return rows


def test_topk_sql(spark):
    assert compare(spark, queries.op2_topk, queries.OP2_SQL, "/root/testdata/sf0.01", digits=15)


@pytest.mark.parametrize("shard", [16, 100_000])
def test_topk_brute_force(spark, shard):
    rows = odd_vectors()
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0, shard_rows=shard).collect()))
    fine = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, v in sorted(fine):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_large_numbers(spark):
    table = spark.createDataFrame([(0, [1e9, 3.0]), (1, [1e9, 5.0]), (2, [-1e9, 5.0])], "vec_id bigint, embedding array<double>")
    a, b, c = [[int(np.floor(256 * x)) for x in v] for v in ([1e9, 3.0], [1e9, 5.0], [-1e9, 5.0])]
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
    clip = lambda s: max(1 - 2**63, min(2**63 - 1, s))
    assert [tuple(r) for r in topk.top_k(table, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, clip(dot(a, b))), (0, 2, 2, clip(dot(a, c)))]


@pytest.mark.parametrize("hot", [False, True])
def test_topk_bounds_exclude_shards(spark, hot):
    """Clustered vectors: a query reaches few of the other shards, also when a third of all rows are alike; results stay exact."""
    rng = np.random.default_rng(5)
    clusters = rng.standard_normal((40, 8)) * 10
    x = np.round(clusters[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 8)) * 0.05, 3)
    if hot:
        x[:2000] = x[0]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    all_ = topk.quantised(table, 256, "vec_id", "embedding").distinct().withColumn("dim", F.size("v"))
    shards = topk.Shards(all_, F.col("vec_id") % 50 == 0, 100)
    sizes = [r["count"] for r in shards.rows.groupBy(*topk.SHARD).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 200
    v = np.floor(256 * x)
    scores = v[::50] @ v.T
    scores[np.arange(120), np.arange(0, 6000, 50)] = -np.inf
    first = shards.put(shards.queries.withColumn("least", F.lit(None).cast("bigint")), 5)
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"))
    assert shards.others(kth).count() < 0.5 * 120 * len(sizes)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, shard_rows=100).collect()}
    want = {(50 * q, r + 1): (int(i), int(s[i])) for q, s in enumerate(scores) for r, i in enumerate(np.lexsort((np.arange(6000), -s))[:5])}
    assert got == want


def brute_nearest(rows, every, k=10):
    fine = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == len(rows[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), d[j]) for j in order]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q, best in want.items():
        mine = found.get(q, {})
        assert sorted(mine) == list(range(1, len(best) + 1))
        assert [s for _, s in sorted((k, v[1]) for k, v in mine.items())] == sorted(v[1] for v in mine.values())
        hits += sum(mine[k][1] <= best[-1][1] + 1e-12 for k in mine)
        total += len(best)
    assert set(found) == set(want)
    return hits / max(1, total)


def test_neighbours_odd_rows(spark):
    rows = odd_vectors()
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, node int")
    got = ann.nearest(table, F.col("vec_id") % 100 == 0).collect()
    assert recall(got, brute_nearest(rows, 100)) >= 0.9
    assert ann.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (5, [1.0, 2.5])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") == 0).collect()] == [(0, 1, 5, 0.5)]


def test_neighbours_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(queries.op7_ann(spark, sf).collect(), brute_nearest(rows, 100)) >= 0.9


def test_neighbours_one_huge_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((4000, 16)))] + [(9001, [1e9] * 16)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    nodes, _ = ann.nodes_of(ann.usable(table))
    want = brute_nearest(rows, 100)
    near = {}
    for r in ann.build_graph(nodes).where("u % 100 = 0").orderBy("u", "d").collect():
        near.setdefault(r.u, []).append(r.v)
    assert np.mean([len({i for i, _ in best} & set(near[q][:10])) / 10 for q, best in want.items()]) >= 0.9


def test_join_passes_all_that_can_enter():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    n, degree = 40, 24
    x = rng.standard_normal((n, 4)).astype(np.float32)
    packed = [np.concatenate([np.zeros(1, np.int32).view(np.float32), row]).tobytes() for row in x]
    far = np.where(np.arange(n) % 2, np.inf, 3.0)
    none = [None] * n
    vectors = [pa.array([5] * n), pa.array(none, pa.int64()), pa.array(np.arange(n)), pa.array(none, pa.bool_()), pa.array(far), pa.array([5] * n), pa.array(packed, pa.binary())]
    edges = [pa.array([5] * n), pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.ones(n, bool)), pa.array(none, pa.float64()), pa.array(none, pa.int64()), pa.array(none, pa.binary())]
    names = ["home", "c", "node", "new", "far", "hn", "h"]
    batches = [pa.RecordBatch.from_arrays(part, names=names) for part in (vectors, edges)]
    got = {(int(u), int(v)) for b in ann._join_around(degree)(iter([batches[0], batches[1].slice(0, 17), batches[1].slice(17)])) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == {(u, int(v)) for u in range(n) for v in np.argsort(d[u])[:degree] if d[u, v] <= far[u]}


def test_neighbours_few_vectors_elsewhere(spark):
    rng = np.random.default_rng(8)
    mean = np.full(16, 6.0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((6000, 16)) + mean)]
    rows += [(10_000 * (1 + i), v.tolist()) for i, v in enumerate(rng.standard_normal((5, 16)) - mean)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(table, F.col("vec_id") % 1000 == 0).collect()
    assert recall(got, brute_nearest(rows, 1000)) >= 0.9  # checks too that every query has 10 rows


def test_search_visits_a_part_and_takes_vectors_from_outside(spark):
    """10,000 vectors in clusters: queries that aren't in the graph, and the share of it whose distance a walk takes."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 32))
    x = centres[rng.integers(0, 20, 10_000)] * 0.4 + rng.standard_normal((10_000, 32)) * 0.3
    asked = centres[rng.integers(0, 20, 60)] * 0.4 + rng.standard_normal((60, 32)) * 0.3
    nodes, _ = ann.nodes_of(ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")))
    graph = ann.written(ann.both_ways(ann.build_graph(nodes)).unionByName(ann.random_links(nodes)).distinct())
    seen = []
    found = ann.search(nodes, graph, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query bigint, x array<double>"), seen_out=seen)
    near = {}
    for r in found.orderBy("query", "d").collect():
        near.setdefault(r.query, []).append(r.node)
    d = ((asked[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.mean([len(set(near[q][:10]) & set(np.argsort(d[q])[:10].tolist())) / 10 for q in range(60)]) >= 0.9
    assert seen[0].count() / 60 <= 0.2 * len(x)
