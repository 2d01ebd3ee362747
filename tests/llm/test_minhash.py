"""Near-duplicates against brute force over all pairs."""

import random

import pytest

from coopspark.llm import minhash, queries


def brute(rows, width, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(top(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def made(seed, n=160):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.choice([3, 12, 60, 140]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(1000))
        rows.append((i * 7 % 1000, " ".join(w).upper() if i % 5 == 0 else "\t".join(w)))
    return rows + [(None, rows[0][1]), (None, "only here with no id at all"), (5000, None), (5001, ""), (5001, " \n"), (5002, "one"), (5003, "one"), rows[3], (6000, "long " * 3000 + "tail"), (6001, "long " * 3000 + "tail")]


@pytest.mark.parametrize(("seed", "width"), [(1, 4), (2, 5)])
def test_brute_force(spark, seed, width, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PER_SALT", 4)
    rows = made(seed)
    docs = spark.createDataFrame([(d, t, 1, b"k") for d, t in rows], "doc_id bigint, text string, row int, keys binary").repartition(3)
    want = brute(rows, width, 80)
    assert sorted(map(tuple, minhash.near_duplicates(docs, width=width).collect()), key=str) == want
    kept = minhash.deduplicate(docs, width=width)
    assert kept.columns == docs.columns
    components = {c for d, n, c, k in want if n and c is not None}
    assert sum(1 for r in kept.collect() if (r.text or '').split() and r.doc_id is not None) == len(components)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op1_minhash(spark, sf_dir).collect()), key=str) == brute(rows, 4, 80)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(docs).count() == 0 and minhash.deduplicate(docs).count() == 0


def test_common_passage_opens_no_pairs(spark, tmp_path):
    """Documents that share 60 of 100 words, and 10 of 25 words each more common still: linear work, and the links among them found."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for i in range(600)]
    twin = rows[5][1].split()
    rows.append((9000, " ".join(twin[:-1] + ["other"])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    described = minhash._described(docs, 5, minhash.PERMUTATIONS, minhash.ROWS)
    members = described.selectExpr("row as rep", "row as component", "keys")
    sets = described.select("row", "text").mapInArrow(minhash._shingled(5), "row bigint, n bigint, set array<bigint>")
    assert minhash._rare_links(members, sets, 80).count() == 1
    assert sorted(map(tuple, minhash.near_duplicates(docs, width=5).collect()), key=str) == brute(rows, 5, 80)


def test_two_families_just_below_the_threshold(spark, monkeypatch):
    """Near copies of two texts that are themselves too far apart: components stay apart, blocks are split."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(4)
    first = [f"a{i}" for i in range(200)]
    second = first[:172] + [f"b{i}" for i in range(28)]
    rows = []
    for i in range(160):
        w = list(first if i % 2 else second)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(map(tuple, minhash.near_duplicates(docs, width=4).collect()), key=str) == brute(rows, 4, 80)


def phrases(n, seed=6):
    """Documents of a common part and two of 20 phrases: most pairs have a similarity just below 0.8, those with a common phrase lie above."""
    rng = random.Random(seed)
    common, some = [f"c{i}" for i in range(150)], [[f"p{k}x{i}" for i in range(9)] for k in range(20)]
    rows = []
    for i in range(n):
        a, b = rng.sample(range(20), 2)
        rows.append((i, " ".join(common[:75] + some[a] + common[75:] + some[b] + [f"own{i}"])))
    return rows


@pytest.mark.parametrize("block", [1024, 40])
def test_near_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = phrases(220)
    # Without the common phrase no pair would be linked: take phrases apart for a part of them.
    rows += [(1000 + i, " ".join(f"{w}{i % 3}" if w.startswith("p") else w for w in t.split())) for i, (_, t) in enumerate(rows[:60])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for width in (4, 5):
        assert sorted(map(tuple, minhash.near_duplicates(docs, width=width).collect()), key=str) == brute(rows, width, 80)


def test_links_in_a_group_as_all_pairs():
    """What a pair of blocks gives connects exactly what all linked pairs connect."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 100)
    sets = [np.unique(np.concatenate([rng.choice(base, 90 - int(k) % 9, replace=False), rng.integers(0, 2**62, int(k) % 7)])) for k in range(120)]
    n = np.array([len(s) for s in sets])
    block = np.arange(120) % 2
    part = (block, np.arange(120), np.arange(120), n, np.zeros(120, np.int64), np.zeros((120, 24), "<u2"), np.concatenate(sets))
    for i, j in ((0, 0), (0, 1), (1, 1)):
        a, b = minhash._Group([part], 80).links(i, j)
        left, right = [np.flatnonzero(block == k).tolist() for k in (i, j)]
        want = [(x, y) for x in left for y in right if x != y and 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))]
        assert set(zip(a.tolist(), b.tolist(), strict=True)) <= {(max(p), min(p)) for p in want} and want

        def roots(edges):
            root = list(range(120))
            for x, y in edges:
                p, q = root[x], root[y]
                root = [q if r == p else r for r in root]
            return {frozenset(k for k in range(120) if root[k] == r) for r in root}

        assert roots(zip(a.tolist(), b.tolist(), strict=True)) == roots(want)
