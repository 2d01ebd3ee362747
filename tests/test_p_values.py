"""Exact p-values against counting all splits, the asymptotic ones against known values."""

from itertools import combinations

import numpy as np
import pytest

from coopspark.operators import rankstats


def every_split(n, m):
    """(|i * m - j * n| at its largest, U) of all ways to place n of n + m untied values."""
    d, u = [], []
    for own in combinations(range(n + m), n):
        mark = np.zeros(n + m, int)
        mark[list(own)] = 1
        i, j = np.cumsum(mark), np.cumsum(1 - mark)
        d.append(int(np.abs(i * m - j * n).max()))
        u.append(int((j * mark).sum()))
    return np.array(d), np.array(u)


@pytest.mark.parametrize(("n", "m"), [(n, m) for n in range(1, 8) for m in range(n, 8)] + [(2, 12), (3, 11), (5, 10)])
def test_all_splits(n, m):
    d, u = every_split(n, m)
    for a, b in ((n, m), (m, n)):
        values = np.unique(d)
        got = rankstats.ks_exact(values / (n * m), np.full(len(values), a), np.full(len(values), b))
        assert got == pytest.approx([np.mean(d >= v) for v in values], rel=1e-12)
        values = np.unique(u)
        got = rankstats.mw_exact(values.astype(float), np.full(len(values), a), np.full(len(values), b))
        assert got == pytest.approx([min(1, 2 * np.mean(u <= min(v, n * m - v))) for v in values], rel=1e-12)
    assert rankstats.mw_counts(n, m, n * m).tolist() == np.bincount(u).tolist()


@pytest.mark.parametrize(("n", "m"), [(12, 12), (7, 12), (9, 12), (12, 11)])
def test_paths_by_full_counting(n, m):
    """All n, m up to 12 are too many splits to list; count paths by a table instead."""
    for h in range(1, n * m + 1):
        ways = np.zeros((n + 1, m + 1))
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i * m - j * n) < h:
                    ways[i, j] = 1 if i == j == 0 else (ways[i - 1, j] if i else 0) + (ways[i, j - 1] if j else 0)
        if h % np.gcd(n, m) == 0:
            all_ = rankstats.math.comb(n + m, n)
            assert rankstats.ks_exact([h / (n * m)], np.array([n]), np.array([m]))[0] == pytest.approx((all_ - ways[n, m]) / all_, rel=1e-9, abs=1e-15)


def test_known_values():
    """From published tables of the two statistics."""
    assert rankstats.ks_exact([1.0, 0.5, 0.0], np.array([3, 4, 5]), np.array([3, 6, 9])) == pytest.approx([0.1, 0.55238095, 1.0])
    assert rankstats.mw_exact(np.array([0.0, 12.0, 0.0]), np.array([3, 3, 5]), np.array([4, 4, 5])) == pytest.approx([2 / 35, 2 / 35, 2 / 252])
    # Critical values at 5 % of two samples of 20: D = 9 / 20 (of 8 / 20 more).
    p = rankstats.ks_exact([9 / 20, 8 / 20], np.array([20, 20]), np.array([20, 20]))
    assert p[0] < 0.05 < p[1]


def test_large_samples_meet_the_series(spark):
    """Ten thousand against ten thousand in one batch with small groups: exact and series agree where both hold; tiny p keep their digits."""
    n, m = np.array([10_000, 9_000, 5, 300]), np.array([10_000, 10_000, 10_000, 9_999])
    d = np.array([0.02, 0.025, 0.5, 0.09])
    got = rankstats.ks_exact(d, n, m)
    rows = spark.createDataFrame([(float(x), int(a), int(b)) for x, a, b in zip(d, n, m, strict=True)], "d double, n bigint, n0 bigint")
    series = [r.p for r in rows.select(rankstats.ks_p_series(rows.d, rows.n, rows.n0).alias("p")).collect()]
    for k in (0, 1, 3):
        assert got[k] == pytest.approx(series[k], rel=0.08)
    assert abs(got[2] - series[2]) > 0.01
    assert rankstats.ks_exact([1.0], np.array([50]), np.array([60]))[0] == pytest.approx(2 / rankstats.math.comb(110, 50), rel=1e-9)


def test_columns_and_methods(spark):
    kind = "name string, n bigint, n0 bigint, ks_d double, mw_u double, tie_sum double"
    stats = spark.createDataFrame([("a", 3, 3, 1.0, 9.0, 0.0), ("b", 40, 60, 0.3, 800.0, 0.0), ("c", 40, 60, 0.0, 1200.0, 0.0), ("d", 3, 4, 1.0, 0.0, 0.0), ("tied", 3, 4, 0.5, 3.0, 6.0), ("large", 20_000, 60, 0.3, 800.0, 0.0)], kind)
    out = {r.name: r for r in rankstats.with_p_values(stats).collect()}
    assert out["a"].ks_p == pytest.approx(0.1) and out["a"].p_method == "exact"
    assert (out["b"].mw_method, out["b"].p_method) == ("normal", "exact") and out["b"].mw_p == pytest.approx(0.00488, abs=2e-4)
    assert out["c"].ks_p == out["c"].mw_p == 1.0
    assert out["d"].mw_p == pytest.approx(2 / 35) and out["d"].mw_method == "exact"
    assert out["tied"].mw_method == "normal" and out["large"].p_method == "series"
    plain = {r.name: r for r in rankstats.with_p_values(stats, "asymptotic").collect()}
    assert {(r.p_method, r.mw_method) for r in plain.values()} == {("series", "normal")} and plain["d"].mw_p == pytest.approx(0.0518, abs=1e-4)
    t = spark.createDataFrame([(2.0, 10), (0.0, 5), (12.706, 1)], "t double, d bigint").select(rankstats.student_two_sided("t", "d").alias("p")).collect()
    assert [r.p for r in t] == pytest.approx([0.07338803, 1.0, 0.05], abs=1e-5)
