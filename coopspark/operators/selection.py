"""The n first rows of an order by hash, without gathering them anywhere.

A row's place is decided by (hash, keys). The n-th place is found like an order
statistic: rows are counted by the first digits of the hash, which gives the
bucket of the n-th row; inside this bucket rows are counted by hash and keys and
summed in order, which gives the last key taken and how many of the rows alike
in it. The rows before that key are a filter on the table, in whatever
partitions it has; of the rows alike, the first ones of their written table are
taken, by per-partition counts. What is gathered are counts of buckets (16 to
the power of ``DIGITS`` at most) and one row that holds the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.operators.running import running_sum
from coopspark.plans.stage import written

DIGITS = 4


def _place(keys: list[str], hash_: Column) -> Column:
    """What rows are ordered by; nulls come first, as in a sort."""
    return F.struct(hash_.alias("hash__"), *[F.col(k).alias(f"key{i}__") for i, k in enumerate(keys)])


def cut_at(df: DataFrame, n: int, keys: list[str], hash_: Column) -> DataFrame:
    """One row (last, taken): the key of the n-th row, and how many of the rows alike in it are among the first n.

    No row if ``df`` has at most n rows: then nothing is cut.
    """
    prefix = F.substring(hash_, 1, DIGITS)
    counted = df.groupBy(prefix.alias("prefix__")).agg(F.count(F.lit(1)).alias("n__"))
    upto = counted.withColumn("upto__", F.sum("n__").over(Window.orderBy("prefix__").rowsBetween(Window.unboundedPreceding, 0)))
    bucket = written(upto.where((F.col("upto__") > n) & (F.col("upto__") - F.col("n__") <= n)).select("prefix__", (F.col("upto__") - F.col("n__")).alias("before__")))
    near = df.withColumn("prefix__", prefix).join(F.broadcast(bucket), "prefix__")  # one row
    alike = near.groupBy(_place(keys, hash_).alias("place__"), "before__").agg(F.count(F.lit(1)).alias("n__"))
    summed = running_sum(alike, "n__", ["place__"], name="upto__").withColumn("upto__", F.col("upto__") + F.col("before__"))
    past = summed.where((F.col("upto__") > n) & (F.col("upto__") - F.col("n__") <= n))
    return written(past.select(F.col("place__").alias("last"), (F.lit(n) - F.col("upto__") + F.col("n__")).alias("taken")))


def first_rows(df: DataFrame, n: int, keys: list[str], hash_: Column) -> DataFrame:
    """The n first rows by (hash, keys), all if there are fewer; rows alike in these are interchangeable.

    ``hash_`` is a text of hexadecimal digits that depends on the keys only.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    cut = F.broadcast(cut_at(df, n, keys, hash_))  # one row at most
    placed = df.withColumn("place__", _place(keys, hash_)).join(cut, F.lit(True), "left")
    before = placed.where(F.col("last").isNull() | (F.col("place__") < F.col("last")))
    tied = written(placed.where(F.col("place__") == F.col("last")).withColumn("row__", F.monotonically_increasing_id()))
    # The ids count up from 0 in each partition: places follow from the partitions' counts.
    part, at = F.shiftright("row__", 33), F.col("row__").bitwiseAND(F.lit((1 << 33) - 1))
    parts = tied.groupBy(part.alias("part__")).agg(F.count(F.lit(1)).alias("n__"))
    sums = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part__", F.coalesce(F.sum("n__").over(sums), F.lit(0)).alias("offset__"))
    tied = tied.withColumn("part__", part).join(offsets, "part__").where(F.col("offset__") + at < F.col("taken"))
    return before.select(*df.columns).unionByName(tied.select(*df.columns))
