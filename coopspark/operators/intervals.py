"""Interval joins by hierarchical bins: half-open intervals, equi-joins on (chrom, level, bin).

Spark has no range join. Bins of level k are ``width * 8**k`` wide, and an
interval's own level is the first whose bins are as long as it is, so there it
touches two bins at most, also if it is a whole chromosome. The longer one of a
pair (by level) lies under its own level's bins, and the shorter one is entered
there as well: a row is entered once for each level that the other side has
above its own. A pair is kept in the first bin that both touch, so nothing is
deduplicated.

Bins are as hot as the data around a locus. Rows are counted by bin first; bins
with more than ``hot_rows`` rows on a side are split: that side's rows are dealt
over as many parts as it takes, and the other side's rows are copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.functions.scalars import resized
from coopspark.plans.stage import small, written

FACTOR_BITS, LEVELS = 3, 14
HOT_ROWS = 20_000
KEYS = ["chrom", "role__", "level__", "bin__"]


def resize_regions(regions: DataFrame, length: int) -> DataFrame:
    """Every region replaced by the ``length`` positions around its centre."""
    start, end = resized(F.col("start"), F.col("end"), length)
    return regions.withColumns({"start": start, "end": end})


def relative_coords(hits: DataFrame, region_start: str = "region_start") -> DataFrame:
    """Adds the start and end relative to the region's start."""
    return hits.withColumn("start_rel", F.col("start") - F.col(region_start)).withColumn("end_rel", F.col("end") - F.col(region_start))


def _suffixed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix) for c in df.columns])


def level_of(start: Column, end: Column, width: int) -> Column:
    """The first level whose bins are as long as the interval."""
    length = end - start
    out = F.when(length <= width, 0)
    for k in range(1, LEVELS):
        out = out.when(length <= width << (FACTOR_BITS * k), k)
    return out.otherwise(LEVELS)


def levels(*sides: DataFrame) -> list[list[int]]:
    """The levels that occur in each table with a column ``own__``: a few numbers, found in one job."""
    each = [side.select(F.lit(k).alias("side"), "own__") for k, side in enumerate(sides)]
    all_ = each[0]
    for one in each[1:]:
        all_ = all_.unionByName(one)
    found = all_.distinct().collect()  # at most LEVELS + 1 rows a side
    return [sorted(r.own__ for r in found if r.side == k) for k in range(len(sides))]


def _at_levels(df: DataFrame, entries: Column) -> DataFrame:
    """A row for each of ``entries``, structs (role, level), with the level's bin width."""
    out = df.withColumn("entry__", F.explode(entries))
    out = out.withColumn("role__", F.col("entry__.role")).withColumn("level__", F.col("entry__.level")).drop("entry__")
    return out.withColumn("wide__", F.expr(f"shiftleft(base__, {FACTOR_BITS} * level__)"))


def _entry(role: int, level: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), level.cast("int").alias("level"))


def _of(levels_: list[int], keep, role: int) -> Column:
    """Entries of those levels for which ``keep`` holds."""
    known = F.array(*[F.lit(x) for x in levels_]).cast("array<int>")
    return F.transform(F.filter(known, keep), lambda x: _entry(role, x))


def _ranged(df: DataFrame, width: int) -> DataFrame:
    return df.where("end > start").withColumn("base__", F.lit(width).cast("bigint")).withColumn("own__", level_of(F.col("start"), F.col("end"), width))


def _touched(df: DataFrame) -> DataFrame:
    return df.withColumn("bin__", F.explode(F.expr("sequence(start div wide__, (end - 1) div wide__)")))


def _joined(left: DataFrame, right: DataFrame, suffix: str, condition: Column, hot_rows: int) -> DataFrame:
    """The equi-join of two entered tables, hot bins split; ``condition`` is on left columns and suffixed right ones."""
    made = ["role__", "level__", "bin__", "wide__", "base__", "own__"]
    out = [c for c in left.columns if c not in made], [c + suffix for c in right.columns if c not in made]

    def meet(a: DataFrame, b: DataFrame, more: list[str]) -> DataFrame:
        other = _suffixed(b, suffix)
        on = condition
        for k in [*KEYS, *more]:
            on &= F.col(k) == F.col(k + suffix)
        return a.join(other, on).select(*out[0], *out[1])

    sides = [df.select(*KEYS, F.lit(k).cast("bigint").alias("l__"), F.lit(1 - k).cast("bigint").alias("r__")) for k, df in ((1, left), (0, right))]
    counts = sides[0].unionByName(sides[1]).groupBy(*KEYS).agg(F.sum("l__").alias("l__"), F.sum("r__").alias("r__")).where(f"l__ > 0 and r__ > 0 and (l__ > {hot_rows} or r__ > {hot_rows})")
    hot = written(counts.select(*KEYS, F.ceil(F.col("l__") / hot_rows).alias("nl__"), F.ceil(F.col("r__") / hot_rows).alias("nr__")))
    if hot.isEmpty():
        return meet(left, right, [])
    keys = hot.select(*KEYS)
    cold = meet(left.join(small(keys), KEYS, "left_anti"), right.join(small(keys), KEYS, "left_anti"), [])

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        # The parts are numbers of a written table: they stay as they are if a task runs again.
        placed = written(df.join(small(hot), KEYS).withColumn(f"{own}_", F.pmod(F.monotonically_increasing_id(), F.col(f"n{own}__"))))
        return placed.withColumn(f"{other}_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n{other}__") - 1))).drop("nl__", "nr__")

    return cold.unionByName(meet(dealt(left, "l", "r"), dealt(right, "r", "l"), ["l_", "r_"]))


def entered_for_containment(regions: DataFrame, hits: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Regions under the bins of their own level, hits under the one bin of their start at each region level from their own up."""
    left, right = _ranged(regions, width), _ranged(hits, width)
    known = levels(left)[0]
    left = _touched(_at_levels(left, F.array(_entry(0, F.col("own__")))))
    right = _at_levels(right, _of(known, lambda x: x >= F.col("own__"), 0))
    return left, right.withColumn("bin__", F.expr("start div wide__"))


def contained(regions: DataFrame, hits: DataFrame, width: int = 1000, suffix: str = "_hit", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Regions with each hit that lies completely inside; distinct rows. Hit columns get ``suffix``.

    A contained hit is no longer than its region and starts in a bin of it, so
    hits have one bin for each level that regions have.
    """
    left, right = entered_for_containment(regions, hits, width)
    inside = (F.col(f"start{suffix}") >= F.col("start")) & (F.col(f"end{suffix}") <= F.col("end"))
    return _joined(left, right, suffix, inside, hot_rows).distinct()


def entered_for_overlap(left: DataFrame, right: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Role 0: right rows at their own level, left rows at each right level from their own up. Role 1: left rows at their own level, right rows at each left level above their own."""
    a, b = _ranged(left, width), _ranged(right, width)
    of_a, of_b = levels(a, b)
    own = F.filter(F.array(_entry(1, F.col("own__"))), lambda e: e["level"] > F.lit(min(of_b, default=LEVELS)))
    a = _at_levels(a, F.concat(_of(of_b, lambda x: x >= F.col("own__"), 0), own))
    b = _at_levels(b, F.concat(F.array(_entry(0, F.col("own__"))), _of(of_a, lambda x: x > F.col("own__"), 1)))
    return _touched(a), _touched(b)


def overlapping(left: DataFrame, right: DataFrame, width: int = 1000, suffix: str = "_r", hot_rows: int = HOT_ROWS) -> DataFrame:
    """All pairs that share a position; right columns get ``suffix``."""
    a, b = entered_for_overlap(left, right, width)
    first = F.greatest(F.expr("start div wide__"), F.expr(f"`start{suffix}` div wide__"))
    met = (F.col("bin__") == first) & (F.col("start") < F.col(f"end{suffix}")) & (F.col(f"start{suffix}") < F.col("end"))
    return _joined(a, b, suffix, met, hot_rows)


def signal_by_region(regions: DataFrame, signal: DataFrame, width: int = 1000, chrom_sizes: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``regions`` with ``signal``: per track the absolute sum of value times overlapping positions, summed over tracks.

    ``signal`` has chrom, start, end, value, track. Regions without signal get
    0.0, and so do, if ``chrom_sizes`` (chrom, size) is given, regions out of
    bounds. Regions alike are one row of the aggregate and come back repeatedly.
    """
    keys = ["chrom", "start", "end"]
    pairs = overlapping(regions.select(*keys).distinct(), signal, width, hot_rows=hot_rows)
    length = F.least("end", "end_r") - F.greatest("start", "start_r")
    per_track = pairs.groupBy(*keys, "track_r").agg(F.abs(F.sum(F.col("value_r") * length)).alias("part"))
    total = per_track.groupBy(*keys).agg(F.sum("part").alias("signal"))
    out = regions.join(total, keys, "left")
    value = F.coalesce("signal", F.lit(0.0))
    if chrom_sizes is None:
        return out.withColumn("signal", value)
    sized = out.join(chrom_sizes.select("chrom", F.col("size").alias("size__")), "chrom", "left")
    inside = (F.col("start") >= 0) & (F.col("end") <= F.col("size__"))
    return sized.withColumn("signal", F.when(inside, value).otherwise(0.0)).drop("size__")


def chip_evidence(hits: DataFrame, peaks: DataFrame, width: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``hits`` (region, chrom, region_start, region_end, tf) with ``evidence``: every component has a peak that overlaps the region."""
    regions = hits.select("region", "chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end")).distinct()
    seen = overlapping(regions, peaks.select("chrom", "start", "end", F.upper("tf").alias("tf")), width, hot_rows=hot_rows)
    names = seen.groupBy("region").agg(F.collect_set("tf_r").alias("seen"))  # at most one entry for each TF
    parts = F.split(F.upper("tf"), "::")
    found = F.forall(parts, lambda p: F.array_contains("seen", p))
    return hits.join(names, "region", "left").withColumn("evidence", F.coalesce(found, F.lit(False))).drop("seen")


def subtract(regions: DataFrame, cuts: DataFrame, width: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(chrom, start, end, gap_start, gap_end): what the cuts leave of each distinct region; empty rests are dropped."""
    keys = ["chrom", "start", "end"]
    base = regions.select(*keys).where("end > start").distinct()
    hits = overlapping(base, cuts.select(*keys), width, hot_rows=hot_rows).select(*keys, F.greatest("start", "start_r").alias("s"), F.least("end", "end_r").alias("e"))
    order = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    before = hits.select(*keys, F.coalesce(F.max("e").over(order), F.col("start")).alias("gap_start"), F.col("s").alias("gap_end"))
    tail = base.join(hits.groupBy(*keys).agg(F.max("e").alias("last")), keys, "left").select(*keys, F.coalesce("last", "start").alias("gap_start"), F.col("end").alias("gap_end"))
    return before.unionByName(tail).where("gap_end > gap_start")
