"""Rank statistics of many groups against one shared null sample.

Both samples are first counted by value; the running count of the null over the
distinct values and the running count of each group are range-partitioned sums,
so neither the null nor a large group is gathered anywhere. Per group follow the
Kolmogorov-Smirnov D, the Mann-Whitney U and its tie term; p-values are computed
on the one row that each group has left, many groups at a time in Arrow batches:

* KS, both samples of at most ``KS_EXACT_ROWS``: exact, the probability that a
  random path of the two samples' steps leaves the band that D allows. Step by
  step the mass of each place inside the band is passed on; what leaves it adds
  up. Only the band's places are held. Larger samples: the Kolmogorov series.
* Mann-Whitney, one sample of at most ``MW_EXACT_ROWS`` and no ties: exact, from
  the counts of U (coefficients of a Gaussian binomial). Else the normal form
  with tie and continuity correction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from coopspark.operators.quantiles import quantiles
from coopspark.operators.running import running_sum

KS_TERMS = 100
KS_EXACT_ROWS = 10_000
MW_EXACT_ROWS = 8
MW_CELLS = 50_000_000  # n * n0 above which U's counts aren't formed (memory); the normal form holds there
BATCH_CELLS = 1_000_000


def rank_pass(groups: DataFrame, null: DataFrame, group: str = "name", value: str = "value") -> DataFrame:
    """(group, n, n0, ks_d, mw_u, tie_sum) for each group; null values don't count.

    ``tie_sum`` is the sum of t**3 - t over the tied values of group and null.
    An empty null gives an empty result.
    """
    z = null.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("zc"))
    g = groups.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("gc"))
    values = z.unionByName(g.select("v", F.lit(0).cast("bigint").alias("zc"))).groupBy("v").agg(F.sum("zc").alias("zc"))
    ranked = running_sum(values, "zc", ["v"], name="le0")
    own = running_sum(g, "gc", ["v"], ["g"], name="le")
    sizes = g.groupBy("g").agg(F.sum("gc").alias("n"))
    totals = z.agg(F.sum("zc").alias("n0"), F.sum(F.expr("cast(zc as double) * zc * zc - zc")).alias("ties0"))
    joined = own.join(ranked, "v").join(sizes, "g").crossJoin(F.broadcast(totals.where("n0 > 0")))  # one row
    at = F.abs(F.expr("le / n - le0 / n0"))
    before = F.abs(F.expr("(le - gc) / n - (le0 - zc) / n0"))
    ties = F.expr("cast(gc + zc as double) * (gc + zc) * (gc + zc) - (gc + zc) - (cast(zc as double) * zc * zc - zc)")
    out = joined.groupBy(F.col("g").alias(group), "n", "n0", "ties0").agg(F.max(F.greatest(at, before)).alias("ks_d"), F.sum(F.expr("gc * (le0 - 0.5D * zc)")).alias("mw_u"), F.sum(ties).alias("more"))
    return out.select(group, "n", "n0", "ks_d", "mw_u", (F.col("ties0") + F.col("more")).alias("tie_sum"))


def ks_p_series(d: Column, n: Column, n0: Column, terms: int = KS_TERMS) -> Column:
    """Two-sided p of D by the Kolmogorov series."""
    en = n.cast("double") * n0 / (n + n0)
    term = lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(F.lit(-2.0) * k * k * d * d * en)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, k: s + term(k))
    # For a vanishing argument the series doesn't converge; its limit is 1.
    return F.when(d * d * en < 0.02, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _leaves_band(n: np.ndarray, m: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Probability that a random path from (0, 0) to (n, m) comes to |i * m - j * n| >= h, where h > 0; n <= m.

    From (i, j) the next step raises i with odds n - i to m - j. At step t a
    path is at (i, t - i), inside for (t * n - h) / (n + m) < i < (t * n + h) / (n + m).
    """
    total = n + m
    width = int(((2 * h) // total).max()) + 4
    at = np.arange(width)
    low = np.zeros(len(n), np.int64)
    mass = np.zeros((len(n), width))
    mass[:, 0] = 1
    out = np.zeros(len(n))
    for t in range(int(total.max())):
        i = low[:, None] + at
        up = np.clip(n[:, None] - i, 0, None) / np.maximum(total - t, 1)[:, None]
        moved = mass * up
        mass = mass - moved
        mass[:, 1:] += moved[:, :-1]
        running = t < total
        gone = (np.abs(i * total[:, None] - (t + 1) * n[:, None]) >= h[:, None]) & running[:, None]
        out += np.where(gone, mass, 0).sum(axis=1)
        mass[gone] = 0
        # The band's lowest place rises by one at most.
        shift = running & (((t + 1) * n - h) // total + 1 > low)
        mass[shift, :-1] = mass[shift, 1:]
        mass[shift, -1] = 0
        low = low + shift
    return out


def ks_exact(d: np.ndarray, n: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """Exact two-sided p of D for samples without ties: one value for each triple."""
    d, n, m = np.asarray(d, float), np.minimum(n, n0).astype(np.int64), np.maximum(n, n0).astype(np.int64)
    # i / n - j / m in whole numbers: multiples of g among products.
    g = np.gcd(n, m)
    h = np.rint(d * (n // g) * m).astype(np.int64) * g
    p = np.ones(len(d))
    todo = np.flatnonzero(h > 0)
    todo = todo[np.argsort((n + m)[todo], kind="stable")]
    while len(todo):
        cells = 2 * h[todo] // (n + m)[todo] + 4
        some = max(1, int(np.searchsorted(np.maximum.accumulate(cells) * np.arange(1, len(todo) + 1), BATCH_CELLS, "right")))
        part, todo = todo[:some], todo[some:]
        p[part] = _leaves_band(n[part], m[part], h[part])
    return np.clip(p, 0, 1)


@F.pandas_udf(DoubleType())
def ks_p_exact(d: pd.Series, n: pd.Series, n0: pd.Series) -> pd.Series:
    """``ks_exact`` of a column; null where d is. Meant for one row a group."""
    known = d.notna().to_numpy()
    out = np.full(len(d), np.nan)
    out[known] = ks_exact(d[known].to_numpy(), n[known].to_numpy(), n0[known].to_numpy())
    return pd.Series(np.where(known, out, None), dtype="float64")


def mw_counts(n: int, m: int, top: int) -> np.ndarray:
    """How many of the splits of n + m untied values into n and m give U = 0, 1, ... top."""
    n, m = min(n, m), max(n, m)
    f = np.zeros(top + 1)
    f[0] = 1
    for i in range(1, n + 1):
        if m + i <= top:
            f[m + i :] = f[m + i :] - f[: top + 1 - m - i]
        padded = np.concatenate([f, np.zeros(-len(f) % i)])
        f = np.cumsum(padded.reshape(-1, i), axis=0).ravel()[: top + 1]
    return f


def mw_exact(u: np.ndarray, n: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """Exact two-sided p of U for samples without ties: twice the tail, at most 1."""
    low = np.minimum(u, n * n0 - u).astype(np.int64)
    p = np.empty(len(low))
    for a, b in {(int(x), int(y)) for x, y in zip(n, n0, strict=True)}:
        at = np.flatnonzero((n == a) & (n0 == b))
        tail = np.cumsum(mw_counts(a, b, int(low[at].max())))
        p[at] = 2 * tail[low[at]] / float(math.comb(a + b, min(a, b)))
    return np.minimum(p, 1)


@F.pandas_udf(DoubleType())
def mw_p_exact(u: pd.Series, n: pd.Series, n0: pd.Series) -> pd.Series:
    """``mw_exact`` of a column; null where u is. Meant for one row a group."""
    known = u.notna().to_numpy()
    out = np.full(len(u), np.nan)
    if known.any():
        out[known] = mw_exact(u[known].to_numpy(), n[known].to_numpy().astype(np.int64), n0[known].to_numpy().astype(np.int64))
    return pd.Series(np.where(known, out, None), dtype="float64")


def mw_z(u: Column, n: Column, n0: Column, tie_sum: Column) -> Column:
    """|z| of U with tie and continuity correction; 0 where everything is tied."""
    total = (n + n0).cast("double")
    spread = n.cast("double") * n0 / 12.0 * ((total + 1) - tie_sum / (total * (total - 1)))
    top = F.abs(u - n.cast("double") * n0 / 2.0) - 0.5
    return F.when(spread > 0, F.greatest(top, F.lit(0.0)) / F.sqrt(spread)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else min(1.0, math.erfc(x / math.sqrt(2)))).astype("float64")


def with_p_values(stats: DataFrame, p_values: str = "auto") -> DataFrame:
    """Adds ks_p, p_method (exact or series), mw_z, mw_p and mw_method (exact or normal).

    ``auto`` takes the exact form where samples are small enough for it (see
    above); ``asymptotic`` never does.
    """
    if p_values not in ("auto", "asymptotic"):
        raise ValueError("p_values must be auto or asymptotic")
    d, u, n, n0 = (F.col(c) for c in ("ks_d", "mw_u", "n", "n0"))
    auto = F.lit(p_values == "auto")
    few = auto & (F.greatest(n, n0) <= KS_EXACT_ROWS)
    untied = auto & (F.least(n, n0) <= MW_EXACT_ROWS) & (F.col("tie_sum") == 0) & (n * n0 <= MW_CELLS)
    out = stats.withColumn("p_method", F.when(few, "exact").otherwise("series")).withColumn("mw_method", F.when(untied, "exact").otherwise("normal"))
    out = out.withColumn("mw_z", mw_z(u, n, n0, F.col("tie_sum")))
    ks, mw = ks_p_series(d, n, n0), normal_two_sided("mw_z")
    if p_values == "auto":
        ks = F.coalesce(ks_p_exact(F.when(few, d), n, n0), ks)
        mw = F.coalesce(mw_p_exact(F.when(untied, u), n, n0), mw)
    return out.withColumn("ks_p", ks).withColumn("mw_p", mw)


def benjamini_hochberg(df: DataFrame, p: str, q: str, tie: str) -> DataFrame:
    """Adds ``q``: p * m / rank, made monotone from the largest p down, at most 1. One row a group, so one window."""
    m = F.count(F.col(p)).over(Window.partitionBy())
    up = Window.orderBy(F.col(p).asc_nulls_last(), tie)
    ranked = df.withColumn("rank__", F.row_number().over(up)).withColumn("raw__", F.col(p) * m / F.col("rank__"))
    down = Window.orderBy(F.col("rank__").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("raw__").over(down)))).drop("rank__", "raw__")


def signed_ks(table: DataFrame, group: str, value: str, min_count: int) -> DataFrame:
    """(group, ks): D of each group against all rows, negative where its median is lower; null below ``min_count`` rows."""
    stats = rank_pass(table.select(F.col(group).alias("name"), F.col(value).alias("value")), table.select(F.col(value).alias("value")))
    counts = table.groupBy(F.col(group).alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    medians = quantiles(table.select(F.col(group).alias("name"), value), value, {"own": 0.5}, ["name"])
    overall = quantiles(table, value, {"overall": 0.5})
    joined = counts.join(medians, "name", "left").join(stats, "name", "left").crossJoin(F.broadcast(overall))  # one row
    signed = F.when(F.col("own") < F.col("overall"), -F.col("ks_d")).otherwise(F.col("ks_d"))
    return joined.select(F.col("name").alias(group), F.when(F.col("rows") >= min_count, signed).alias("ks"))


def adjacent_tests(table: DataFrame, category: str, value: str, order: list[str], p_values: str = "auto") -> DataFrame:
    """(a, b, n_a, n_b, mw_u, mw_z, mw_p, mw_method): Mann-Whitney of neighbouring categories that both have more than one row."""
    out = None
    for a, b in zip(order, order[1:], strict=False):
        left = table.where(F.col(category) == a).select(F.lit(a).alias("name"), F.col(value).alias("value"))
        right = table.where(F.col(category) == b).select(F.col(value).alias("value"))
        one = with_p_values(rank_pass(left, right).where("n > 1 and n0 > 1"), p_values)
        one = one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n").alias("n_a"), F.col("n0").alias("n_b"), "mw_u", "mw_z", "mw_p", "mw_method")
        out = one if out is None else out.unionByName(one)
    return out


def pearson(table: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """(group..., n, r, t, p): correlation, its t statistic and two-sided p; null with fewer than three rows, p 0 on a line."""
    both = table.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    r = F.when(F.col("n") > 2, F.col("r"))
    out = both.withColumn("r", r).withColumn("t", F.when(F.abs("r") < 1, F.expr("r * sqrt((n - 2) / (1 - r * r))")))
    return out.withColumn("p", F.when(F.abs("r") >= 1, 0.0).otherwise(student_two_sided(F.col("t"), F.col("n") - 2)))


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic by the regularised incomplete beta function's continued fraction."""

    def beta(x: float, a: float, b: float) -> float:
        if x in (0.0, 1.0):
            return x
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(1 - x, b, a)
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        total = d
        for k in range(1, 500):
            for top in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
                d = 1 / (1 + top * d)
                c = 1 + top / c
                total *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return front * total / a

    return pd.Series([None if pd.isna(x) or n < 1 else beta(n / (n + x * x), n / 2, 0.5) for x, n in zip(t, df, strict=True)], dtype="float64")
