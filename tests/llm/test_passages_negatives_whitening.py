"""Passages, hard negatives and whitening against SQL and brute force."""

import random
import re

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from coopspark.llm import decontaminate, hardneg, queries, whitening


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def passages(text, items, width):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        other = words(t)
        n = min(width, len(other))
        for a in range(len(other) - n + 1 if n else 0):
            for q in range(len(own) - n + 1):
                if own[q : q + n] == other[a : a + n]:
                    hit |= set(range(q, q + n))
                    found.add("" if item is None else str(item))
    return len(own), sorted(hit), sorted(found)


def made_texts():
    rng = random.Random(4)
    some = ["a", "b", "ab", "zé", "Xyz", "longword", "ñññ", "o", "I", "42"]
    text = lambda n: "".join(rng.choice(some) + rng.choice([" ", "  ", ", ", "\n", ".", "-"]) for _ in range(n))
    items = [(k % 9, text(rng.randrange(0, 25))) for k in range(24)] + [(None, "zé o"), (5, None), (6, " . "), (10, text(40)), (10, text(3)), (11, "o o o o o o o o o o o o")]
    docs = [(k, text(rng.randrange(0, 80))) for k in range(40)] + [(50, None), (51, ""), (52, "-.-"), (53, "o " * 30), (53, "o " * 30), (None, "Zé, o")]
    docs += [(100 + k, f"start {t} end") for k, (_, t) in enumerate(items)]
    docs += [(200, "x " * 30_000 + (items[27][1]) + " y" * 30_000)]
    return docs, items


@pytest.mark.parametrize(("width", "group"), [(10, 1 << 24), (10, 300), (3, 200), (1, 1 << 24)])
def test_passages_brute_force(spark, width, group):
    docs, items = made_texts()
    d = spark.createDataFrame([(i, t, "en", 1) for i, t in docs], "doc_id bigint, text string, items string, row int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = []
    for r in decontaminate.find_passages(d, b, width, group).collect():
        places = [p for s in r.spans for p in range(s["first"], s["first"] + s["words"])]
        assert all(x["first"] + x["words"] < y["first"] for x, y in zip(r.spans, r.spans[1:], strict=False))
        got.append((str(r.doc_id), r.n_words, places, r["items"]))
    assert sorted(got) == sorted((str(i), *passages(t, items, width)) for i, t in docs)


def test_passages_empty(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.find_passages(d, b.limit(0)).collect()] == [(1, 2, [], [])]
    assert decontaminate.find_passages(d.limit(0), b).count() == 0


def test_one_text_of_many_items(spark):
    """A text that many items share is spread over the groups, and each item is found."""
    text = "one two three four five six"
    items = spark.createDataFrame([(k % 60, text) for k in range(180)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"zero {text} seven"), (2, "one two three four five")], "doc_id bigint, text string")
    got = {r.doc_id: (r["items"], [tuple(s) for s in r.spans]) for r in decontaminate.find_passages(docs, items, 10, 600).collect()}
    assert got == {1: (sorted(map(str, range(60))), [(1, 6)]), 2: ([], [])}


def test_shift_tables_skip():
    """Where no block is known, the search moves by the largest shift."""
    made = decontaminate.compile_patterns([("1", b" one two three four five six seven eight nine ten ")], 10)
    only = made.classes[0]
    seen = []
    hashed = only.hash
    only.hash = lambda blocks: (seen.append(len(blocks)), hashed(blocks))[1]
    text = np.frombuffer(b" unrelated words " * 2000, np.uint8)
    assert not len(only.search(text, made.text)[0]) and sum(seen) < 1.1 * len(text) / (only.m - only.b + 1)


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_hard_negatives"])
def test_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.001", digits=15)


def labelled_vectors():
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((300, 5)), 1)
    rows = [(i, v.tolist(), int(rng.integers(0, 4))) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), i % 2) for i in range(150)]  # a third of all rows are alike
    rows += [(50, rows[50][1], rows[50][2]), (100, x[3].tolist(), 9), (2000, None, 1), (2050, [1.0] * 5, None), (2100, [float("nan")] * 5, 1), (2150, [None] * 5, 1), (2200, [0.0] * 5, 1)]
    return rows + [(2201, [0.0] * 5, 1), (1, [0.0] * 5, 2), (2250, [], 1), (2300, [1.0, 2.0], 1), (2301, [1.0, 2.0], 1), (2302, [0.5, 1.5], 2), (None, [1.0] * 5, 1), (2350, [1e6] * 5, 1), (2351, [6e5] * 5, 2), (2352, [1e6] * 5, 1)]


def mined(rows):
    fine = {(i, y, tuple(int(np.floor(256 * c)) for c in v)) for i, v, y in rows if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    anchors = {}
    for i, y, v in sorted(fine, key=lambda r: (r[0], len(r[2]), r[1], r[2])):
        if i % 50 == 0:
            anchors.setdefault(i, (y, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, y == label) for i, y, w in fine if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:5]:
            inside = [(t, i) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block", [17, 100_000])
def test_hard_negatives_brute_force(spark, block):
    rows = labelled_vectors()
    table = spark.createDataFrame([(i, v, y, 1) for i, v, y in rows], "vec_id bigint, embedding array<double>, label int, rank int")
    got = sorted(map(tuple, hardneg.mine(table, F.col("vec_id") % 50 == 0, block_rows=block).collect()))
    assert got == mined(rows) and any(r[0] == 2200 for r in got)
    assert hardneg.mine(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_packed_keys_sort():
    rng = random.Random(2)
    rows = [(rng.randrange(-3, 3), rng.choice([-(2**63) + 1, -5, 0, 7, 2**63 - 1]), rng.random() < 0.5, rng.randrange(-4, 4)) for _ in range(500)]
    keys = sorted(hardneg.pack(*r) for r in rows)
    assert [hardneg.unpack(k) for k in keys] == sorted(rows, key=lambda r: (r[0], -r[1], not r[2], r[3]))


def reference_whitening(x, k):
    x = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), z @ vectors / np.sqrt(values), values / np.trace(z.T @ z / n)


@pytest.mark.parametrize("spread", [1.0, 1e-9])
def test_whitening_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 12)) @ np.diag([20, 15, 11, 8, 6, 5, 4, 3, 2.5, 2, 1.5, 1.2]) * (1 if spread == 1 else 3e6)
    table = spark.createDataFrame([(i, v, "x") for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, n string")
    odd = [(7000, None), (7001, []), (7002, [None] * 12), (7003, [float("nan")] * 12), (7004, [1.0] * 5), (7005, [1e300] * 12)]
    both = table.unionByName(spark.createDataFrame([(i, v, "") for i, v in odd], table.schema))
    got = whitening.whiten(both, components=32).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, share = reference_whitening(x, 12)
    assert len(got) == 500 * 12 and set(got.n) == {n}
    assert [int(v) for v in got.deviation[got.component == 1]] == ([int(v) for v in deviation] if spread == 1 else [int(v) for v in exact_deviation(x)])
    own = got.whitened.to_numpy().reshape(500, 12)
    assert np.allclose(own * np.sign((own * white).sum(axis=0)), white, atol=1e-9)
    assert np.allclose(got.explained.to_numpy()[:12], share, rtol=1e-10) and set(got.identity_error) == {got.identity_error.iloc[0]} and got.identity_error.iloc[0] < 1e-10
    assert whitening.whiten(table.limit(0)).count() == 0


def exact_deviation(x):
    whole = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in x]
    s = [sum(c) for c in zip(*whole, strict=True)]
    return [sum((len(whole) * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in whole]


def test_whitening_of_dependent_dimensions(spark):
    """Constant and dependent dimensions are no components; repeated rows and null ids are rows."""
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((60, 2)) * 640) / 64
    rows = [(None if i < 3 else i % 40, [float(a), 1.5, float(b), float(a + b)]) for i, (a, b) in enumerate(x)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert len(got) == 120 and got.vec_id.isna().sum() == 6 and got.identity_error.iloc[0] < 1e-10 and abs(got.explained[got.component <= 2].unique().sum() - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id bigint, embedding array<double>")).count() == 0


def test_jacobi_on_close_eigenvalues():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    v = (q * (1 + np.arange(30) * 1e-4)) @ q.T
    lower, order = whitening.pivoted_cholesky(v.astype(np.longdouble))
    assert np.allclose(lower @ lower.T, v[np.ix_(order, order)], atol=1e-14)
    turned = whitening.one_sided_jacobi(lower).astype(float)
    assert np.allclose((turned**2).sum(axis=0), np.linalg.eigvalsh(v)[::-1], rtol=1e-13)


def test_whitening_query(spark, sf_dir):
    got = queries.op13_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, white, share = reference_whitening(np.stack(rows.embedding).astype(float), 32)
    own = got.whitened.to_numpy().reshape(n, 32)
    assert (got.deviation[got.component == 1].to_numpy() == deviation).all() and np.allclose(own * np.sign((own * white).sum(axis=0)), white, atol=1e-8)
    assert np.allclose(got.explained.to_numpy()[:32], share, rtol=1e-9) and got.identity_error.iloc[0] < 1e-10
