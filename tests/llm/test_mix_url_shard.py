"""Mixing and url rules against SQL; sharding against its own law and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from coopspark.llm import mixing, queries, sharding, urlfilter


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, name, sf):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], sf, digits=15)


def test_mix_targets_and_rows(spark):
    made = [(i, "w " * (1 + i % 7), s) for s, n in [("a", 30), ("b", 300), (None, 40), ("c", 2000)] for i in range(n)]
    made += [(5, None, "d"), (None, "", "d"), (7, "x " * 30_000, "b"), (7, "x " * 30_000, "b")]
    docs = spark.createDataFrame([(a, b, c, 1.0, 2) for a, b, c in made], "doc_id bigint, text string, source string, q double, size int")
    out = mixing.sample(docs).collect()
    assert len(out) == len(made)
    taken, target, full = Counter(), {}, Counter()
    for r in out:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        full[r.source] += r.size
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(full.values()))
    for s in target:
        assert target[s] <= 2 * full[s] + 1e-6
        # Source b's words are nearly all in two rows of 30,000: its sum is within half of such a row.
        assert abs(taken[s] - target[s]) <= (15_000 if s == "b" else max(4, 0.001 * target[s]))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in out)
    assert Counter(map(tuple, mixing.sample(docs.repartition(5)).collect())) == Counter(map(tuple, out))


def alike(n, words="a b c d", ident=1):
    return [(ident, words, "s")] * n


@pytest.mark.parametrize("rows", [alike(1000), alike(1000, ident=None), alike(700) + [(i, "a b c d", "s") for i in range(2, 302)], [(i, "a b c d", "s") for i in range(1000)], alike(400) + alike(300, "x y", 2) + alike(300, "w " * 9, 3), alike(333) + [(i, "a b c", "t") for i in range(667)]])
def test_mix_of_repeated_rows(spark, rows):
    """Of rows alike any number can be taken: each source comes within a document of its target."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    out = mixing.sample(docs).collect()
    assert len(out) == len(rows)
    for s in {r.source for r in out}:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2, s
        assert all(r.taken <= 2 * r.size for r in own)
    assert mixing.mix(docs).count() == sum(r.copies for r in out)
    assert Counter(map(tuple, mixing.sample(docs.repartition(7)).collect())) == Counter(map(tuple, out))


def test_mix_sql_of_repeated_rows(spark, tmp_path):
    rows = alike(70) + alike(50, "x y", 2) + alike(40, "w " * 9, None) + [(i, "a b c " * (1 + i % 3), "t") for i in range(100)] + [(5, None, None), (6, "", "t")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, queries.op6_mixing, queries.OP6_SQL, str(tmp_path), digits=15)


def test_mix_passes_over_a_document_that_does_not_fit(spark):
    docs = spark.createDataFrame([(0, "x " * 20_000, "a")] + [(i, "w " * 100, "a") for i in range(1, 201)], "doc_id bigint, text string, source string")
    for seed in ("a", "b"):
        out = mixing.sample(docs, share=1.25, seed=seed).collect()
        assert abs(sum(r.taken for r in out) - 1.25 * 40_000) <= 50


def test_mix_inclusion_is_unequal_as_intended(spark):
    """Over many seeds, how often a document gets its extra copy: min(1, e / size), whatever its size."""
    from pyspark.sql import functions as F

    seeds, each, sizes = 12, 100, [[5, 20, 60, 150][i % 4] for i in range(400)]
    rest = 0.4 * sum(sizes)
    level = (rest - each * 5 - each * 20) / (2 * each)  # sizes 5 and 20 are certain
    assert 20 < level < 60
    # A source for each seed: they are planned on their own, all alike.
    sized = spark.createDataFrame([(i, f"s{seed:02}", n) for seed in range(seeds) for i, n in enumerate(sizes)], "doc_id bigint, source string, size bigint")
    draws = sized.withColumn("u", (F.pmod(F.xxhash64("doc_id", "source"), F.lit(1 << 40)) + 0.5) / float(1 << 40))
    taken = Counter()
    for r in mixing.copies(draws, mixing.plan(draws, (1.0,), 0.4)).collect():
        taken[r.size] += r.copies
    for size in (5, 20, 60, 150):
        assert abs(taken[size] / (each * seeds) - min(1, level / size)) <= 0.06, size


def test_mix_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.sample(docs).count() == 0 and mixing.mix(docs).count() == 0


URLS = [
    (1, "http://a.NET/x"), (1, "http://a.NET/x"), (2, "http://net"), (3, "https://www.example.net/en/1"), (4, "https://example.net/de/1"), (5, None), (6, "no scheme/net/"), (None, "http://x.org/fr/"), (7, "http://notexample.com/de/"), (8, "http://m.example.com/de/?a#b"), (9, "http://exam.ple.org/f?r/"), (10, "://net/"), (11, "http://net/" + "p/" * 20_000), (12, ""),
]


def verdicts(rules):
    out = []
    for i, u in URLS:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((i, host, path, max(fit)[3] if fit else None, max(fit)[4] if fit else "allow"))
    return sorted(out, key=str)


@pytest.mark.parametrize(("limit", "hexes"), [(0, 8), (50_000, 8), (50_000, 1), (0, 1)])
def test_urls_odd_rows(spark, limit, hexes):
    """``hexes`` of 1: rules collide on their prefix, and the digest rejects."""
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS], "page_id bigint, url string, host string, rule string")
    for rules in (queries.URL_RULES, [("org", "/f", "block"), ("ple.org", "", "allow"), ("net", "/" + "p/" * 9_000, "allow")], [(f"host{i}.net", "/", "block") for i in range(40)], []):
        table = spark.createDataFrame(rules, urlfilter.RULES)
        assert sorted(map(tuple, urlfilter.judge(pages, table, broadcast_rows=limit, prefix_hex=hexes).collect()), key=str) == verdicts(rules)
    assert urlfilter.judge(pages.limit(0), table).count() == 0


def plain_feistel(row, n, seed):
    """The permutation in Python's integers, written down a second time."""
    bits, most = max(1, ((n - 1).bit_length() + 1) // 2), 2**64
    keys, state = [], seed
    for _ in range(6):
        state = (state + 0x9E3779B97F4A7C15) % most
        z = (state ^ state >> 30) * 0xBF58476D1CE4E5B9 % most
        keys.append(z ^ z >> 27)
    while True:
        left, right = row >> bits, row % 2**bits
        for key in keys:
            x = (right ^ key) * 0xD6E8FEB86659FD93 % most
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % most
            left, right = right, left ^ (x ^ x >> 29) % 2**bits
        row = left << bits | right
        if row < n:
            return row


def test_shards(spark, sf_dir):
    out = queries.op9_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in out:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(24)]
    assert sum(counts) == len(docs) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    order = sorted((r.doc_id, r.text_crc32) for r in out)
    n, at = len(order), {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in out}
    for row, key in enumerate(order):
        place = plain_feistel(row, n, 20_240_607)
        assert at[key] == (place % 24, place // 24)
        assert sharding.row_at(*at[key], n, 24, 20_240_607) == row


def test_shards_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x", 5), (1, "x", 5), (None, None, 6), (2, "", 7), (3, "ü" * 100_000, 8)], "doc_id bigint, text string, row int")
    out = sharding.assign(docs, 3).collect()
    assert sorted(r.row for r in out) == [0, 1, 2, 3, 4]
    assert sorted((r.shard, r.slot) for r in out) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert {r.size for r in out} == {9, 8, 200_008}
    assert sharding.assign(docs.limit(0), 3).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**63))
def test_permutation(n, seed):
    places = sharding.permute(np.arange(n), n, seed)
    assert sorted(places.tolist()) == list(range(n))
    assert sharding.row_of(places, n, seed).tolist() == list(range(n))
