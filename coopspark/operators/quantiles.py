"""Exact quantiles from value counts, without a map of all distinct values in one task.

Rows are counted by value first; the running counts are range-partitioned sums,
so a quantile's two neighbours are found by a filter and one small aggregate.

Where a bounded error of rank will do, ``sketched`` keeps one KLL sketch for each
group and partition instead, and merges these: nothing but sketches is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coopspark.operators.running import running_sum


def quantiles(df: DataFrame, value: str, at: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """(group..., a column for each name of ``at``): quantiles by linear interpolation, as Spark's ``percentile``.

    Null values don't count. Without groups there is one row, of nulls if the
    table is empty; groups without a value have no row.
    """
    group = group or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("v__")).agg(F.count(F.lit(1)).alias("c__"))
    up = running_sum(counted, "c__", ["v__"], group, name="upto__")
    totals = up.groupBy(*[F.col(g).alias(f"{g}__") for g in group]).agg(F.sum("c__").alias("n__"))
    match = F.lit(True)
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"{g}__"))
    joined = up.join(totals, match) if group else up.crossJoin(F.broadcast(totals))  # one row
    ends = []
    for name, p in at.items():
        place = F.lit(p) * (F.col("n__") - 1)
        for side, row in (("low", F.floor(place)), ("high", F.ceil(place))):
            ends.append(F.max(F.when((F.col("upto__") > row) & (F.col("upto__") - F.col("c__") <= row), F.col("v__"))).alias(f"{name}_{side}__"))
    found = joined.groupBy(*group).agg(F.max("n__").alias("n__"), *ends)

    def between(name: str, p: float):
        low, high, place = F.col(f"{name}_low__"), F.col(f"{name}_high__"), F.lit(p) * (F.col("n__") - 1)
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name)

    return found.select(*group, *[between(name, p) for name, p in at.items()])


def rank_error(k: int) -> float:
    """The normalised rank error that a KLL sketch of parameter ``k`` keeps with 99 % confidence."""
    return 2.296 / k**0.9021


def sketched(df: DataFrame, value: str, at: dict[str, float], group: list[str] | None = None, k: int = 2000) -> DataFrame:
    """(group..., a column for each name of ``at``): values whose rank is within ``rank_error(k)`` of the one asked for.

    As ``quantiles`` otherwise; values are of the table, not interpolated, and
    may differ between runs.
    """
    if not 8 <= k <= 65535:
        raise ValueError("k must be between 8 and 65535")
    own = df.where(F.col(value).isNotNull()).withColumn("v__", F.col(value).cast("double"))
    sketch = own.groupBy(*(group or [])).agg(F.kll_sketch_agg_double("v__", F.lit(k)).alias("sketch__"), F.count(F.lit(1)).alias("n__"))
    return sketch.select(*(group or []), *[F.when(F.col("n__") > 0, F.kll_sketch_get_quantile_double("sketch__", F.lit(p))).alias(name) for name, p in at.items()])
