"""Windows over one long order, in many tasks.

Rows get their place in the order from range-partitioned counts. Centred frames
are computed in blocks of places: a row near a block's border is copied to the
next block, so that a block holds all frames of its own rows; copies are at most
a frame's width for each block. Runs need only a row's two neighbours: inside a
range partition these are a window away, and the first and last rows of the
partitions stitch the borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.operators.running import running_sum
from coopspark.plans.stage import split_count, written


def placed(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "place") -> DataFrame:
    """Adds each row's place from 1 in ``order`` within ``group``; rows that tie are in any order."""
    own = df.withColumn("one__", F.lit(1).cast("bigint"))
    return running_sum(own, "one__", order, group, name, rows=True).drop("one__")


def rolling_means(df: DataFrame, columns: dict[str, str], order: list[str], width: int, group: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Adds for each (name, column) the centred mean over ``width`` rows; null where the frame isn't full of values.

    A frame of even width has one row more before the row than after it.
    ``block`` is the number of places that a task's unit of work covers; by
    default a group is cut for the session's partitions.
    """
    if width < 1:
        raise ValueError("width must be positive")
    group = group or []
    before, after = width // 2, (width - 1) // 2
    own = written(placed(df, order, group, "place__"))
    if block is None:
        block = -(-(own.agg(F.max("place__")).first()[0] or 1) // split_count(df))
    block = max(block, width)  # a frame then reaches into the next block at most
    at = (F.col("place__") - 1) / F.lit(block)
    home = F.floor(at)
    reach = F.array_distinct(F.array(F.floor((F.col("place__") - 1 - after) / F.lit(block)), home, F.floor((F.col("place__") - 1 + before) / F.lit(block))))
    copied = own.withColumn("home__", home).withColumn("block__", F.explode(reach))
    frame = Window.partitionBy(*group, "block__").orderBy("place__").rowsBetween(-before, after)
    for name, column in columns.items():
        copied = copied.withColumn(name, F.when(F.count(column).over(frame) == width, F.avg(column).over(frame)))
    return copied.where("block__ = home__").select(*df.columns, *columns)


def with_neighbours(df: DataFrame, value: Column, order: list[str], group: list[str] | None = None, before: str = "before", after: str = "after", parts: int | None = None) -> DataFrame:
    """Adds structs (value) of the row before and the row after in ``order`` within ``group``; null where there is none.

    ``order`` should be total; rows that tie in it keep any order, the same for both.
    """
    group = group or []
    keys = [*group, *order]
    ranged = df.withColumn("value__", value).repartitionByRange(parts or split_count(df), *keys)
    own = written(ranged.withColumn("part__", F.spark_partition_id()))
    inside = Window.partitionBy("part__", *group).orderBy(*order)
    mark = F.struct(F.col("value__").alias("value"))
    own = own.withColumn(before, F.lag(mark).over(inside)).withColumn(after, F.lead(mark).over(inside))
    own = written(own)
    ends = own.groupBy(*group, "part__").agg(F.max(F.when(F.col(before).isNull(), mark)).alias("first__"), F.max(F.when(F.col(after).isNull(), mark)).alias("last__"))
    along = Window.partitionBy(*group).orderBy("part__")  # one row a group and partition
    ends = ends.select(*[F.col(g).alias(f"{g}__") for g in group], F.col("part__").alias("at__"), F.lag("last__").over(along).alias("left__"), F.lead("first__").over(along).alias("right__"))
    match = F.col("part__") == F.col("at__")
    for g in group:
        match &= F.col(g).eqNullSafe(F.col(f"{g}__"))
    return own.join(ends, match).select(*df.columns, F.coalesce(before, "left__").alias(before), F.coalesce(after, "right__").alias(after))
