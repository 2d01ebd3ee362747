"""Running sums over a sort order without putting a group, or the table, into one task.

Rows are range-partitioned by (group, order); each partition's totals, one row
for each group and partition, give the offset of the next ones; the window then
runs inside (group, partition) only. A group with a third of all rows spreads
over a third of the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.plans.stage import split_count, written


def running_sum(df: DataFrame, value: str, order: list[str | Column], group: list[str] | None = None, name: str = "running", rows: bool = False) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row, in ``order`` within ``group``.

    Rows that tie in ``order`` get the sum including all of them, or, with
    ``rows=True``, sums row by row (ties then in any order). Null groups form a
    group. An empty table gives an empty table.
    """
    group = group or []
    taken = {c.lower() for c in df.columns}
    if taken & {name.lower(), "part__"}:
        raise ValueError(f"a column {name} or part__ exists already")
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = written(df.repartitionByRange(split_count(df), *keys).withColumn("part__", F.spark_partition_id()))
    per_part = placed.groupBy(*group, "part__").agg(F.sum(value).alias("sum__"))
    before = Window.partitionBy(*group).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(*[F.col(g).alias(f"{g}__") for g in group], F.col("part__").alias("at__"), F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("offset__"))
    match = F.col("part__") == F.col("at__")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"{g}__"))
    inside = Window.partitionBy("part__", *group).orderBy(*order)
    if rows:
        inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn(name, F.sum(value).over(inside))
    return local.join(offsets, match, "left").withColumn(name, F.col(name) + F.coalesce("offset__", F.lit(0))).select(*df.columns, name)
