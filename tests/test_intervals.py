"""Interval joins against plain loops: short and chromosome-long intervals, hot bins."""

import random

import pytest
from pyspark.sql import functions as F

from coopspark.operators import intervals

KIND = "chrom string, start bigint, end bigint, i int"


def random_intervals(seed, n, top=300, longest=60):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), s, s + rng.randrange(0, longest), i) for i in range(n) for s in [rng.randrange(top)]]
    # Some are much longer, one is everything.
    rows += [(rng.choice("ab"), s, s + rng.choice([100, 900, 5000]), n + i) for i, s in enumerate(rng.sample(range(top), 12))]
    return rows + [("a", -5, 10_000, n + 12), ("b", 0, 1, n + 13)]


@pytest.mark.parametrize(("width", "hot"), [(7, 20_000), (1000, 20_000), (20, 9), (3, 1)])
def test_interval_joins(spark, width, hot):
    left, right = random_intervals(1, 50), random_intervals(2, 50)
    a, b = spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND)
    fine = [(x, y) for x in left for y in right if x[0] == y[0] and x[2] > x[1] and y[2] > y[1]]
    met = sorted((r.i, r.i_r) for r in intervals.overlapping(a, b, width, hot_rows=hot).collect())
    assert met == sorted((x[3], y[3]) for x, y in fine if x[1] < y[2] and y[1] < x[2])
    inside = sorted((r.i, r.i_hit) for r in intervals.contained(a, b, width, hot_rows=hot).collect())
    assert inside == sorted((x[3], y[3]) for x, y in fine if x[1] <= y[1] and y[2] <= x[2])
    gaps = {(r.chrom, p) for r in intervals.subtract(a, b.where("i % 5 <> 2"), width, hot_rows=hot).collect() for p in range(r.gap_start, r.gap_end)}
    covered = {(c, p) for c, s, e, i in right if i % 5 != 2 for p in range(s, e)}
    assert gaps == {(c, p) for c, s, e, _ in left for p in range(s, e)} - covered
    assert intervals.overlapping(a, b.limit(0), width).count() == intervals.contained(a.limit(0), b, width).count() == 0


def test_a_chromosome_is_entered_like_any_interval(spark):
    """Rows entered: two for an interval of 100 Mb; short ones once more for the level that it adds."""
    long = spark.createDataFrame([("a", 1000, 100_001_000), ("a", 5000, 5200)], "chrom string, start bigint, end bigint")
    short = spark.range(5000).select(F.lit("a").alias("chrom"), (F.col("id") * 20_011).alias("start"), (F.col("id") * 20_011 + 10).alias("end"))
    for entered in (intervals.entered_for_overlap(long, short, 1000), intervals.entered_for_overlap(short, long, 1000)):
        sizes = sorted(e.count() for e in entered)
        assert sizes[0] <= 6 and sizes[1] <= 2.1 * 5000, sizes
    regions, hits = intervals.entered_for_containment(long, short, 1000)
    assert regions.count() <= 4 and hits.count() == 10_000
    want = [r for r in short.collect() if r.start < 100_001_000 and r.end > 1000]
    assert intervals.overlapping(long.limit(1), short, 1000).count() == len(want)
    assert intervals.contained(long.limit(1), short, 1000).count() == sum(r.start >= 1000 and r.end <= 100_001_000 for r in want)


def test_hot_bins_are_split_by_count(spark):
    """A third of all rows are alike in one bin; nothing is set by hand, and no part of a bin is larger than asked."""
    left = spark.createDataFrame([("a", 0, 100)] * 3 + [("a", 10 * i, 10 * i + 30) for i in range(200)], "chrom string, start bigint, end bigint")
    right = spark.range(6000).select(F.lit("a").alias("chrom"), F.when(F.col("id") < 2000, 50).otherwise(F.col("id") % 1990).alias("start"), F.when(F.col("id") < 2000, 55).otherwise(F.col("id") % 1990 + 5).alias("end"), "id")
    plain = left.alias("l").join(right.alias("r"), F.expr("l.start < r.end and r.start < l.end")).count()
    split = intervals.overlapping(left, right, 1000, hot_rows=500)
    assert split.count() == plain and "l_" in split._jdf.queryExecution().toString()
    unsplit = intervals.overlapping(left, right, 1000)
    assert sorted(map(str, unsplit.collect())) == sorted(map(str, split.collect()))
    assert "l_" not in unsplit._jdf.queryExecution().toString().replace("l__", "")


def test_split_bins_leave_results_alone(spark):
    spans = [("1", 5000 + i % 50, 5040 + i % 90) for i in range(200)] + [("1", 37 * i, 37 * i + 30) for i in range(400)]
    right = spark.createDataFrame([(*s, float(i % 11), f"t{i % 2}", f"T{i % 4}") for i, s in enumerate(spans)], "chrom string, start bigint, end bigint, value double, track string, tf string")
    left = spark.createDataFrame([("1", 500 * i, 500 * i + 700) for i in range(30)] + [("2", 0, 10)], "chrom string, start bigint, end bigint")
    hits = left.select(F.monotonically_increasing_id().alias("region"), "chrom", F.col("start").alias("region_start"), F.col("end").alias("region_end"), F.lit("T1::T3").alias("tf"))
    for f in (lambda n: intervals.contained(left, right, hot_rows=n), lambda n: intervals.signal_by_region(left, right, hot_rows=n), lambda n: intervals.subtract(left, right, hot_rows=n), lambda n: intervals.chip_evidence(hits, right, hot_rows=n)):
        assert sorted(map(str, f(20_000).collect())) == sorted(map(str, f(40).collect()))
