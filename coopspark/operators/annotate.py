"""Reference annotations of TF and TF-pair tables: families, known pairs, cofactors, name lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coopspark.functions.scalars import binding_flag, canonical_pair
from coopspark.plans.stage import small

#: A family text that contains one of these says that there is no family.
NO_FAMILY = ["Not in JASPAR", "nan", "None"]


def _no_family(name: Column) -> Column:
    out = name.isNull()
    for said in NO_FAMILY:
        out = out | name.contains(said)
    return out


def annotate_family(table: DataFrame, families: DataFrame, pair_col: str | None = "tf_pair") -> DataFrame:
    """Adds family1, family2, same_family (pairs) or family (single TFs); names meet in upper case.

    Idempotent: columns from an earlier call are replaced. ``families`` has symbol and family.
    """
    ref = small(families.select(F.upper("symbol").alias("symbol__"), F.col("family").alias("family__")).dropDuplicates(["symbol__"]))
    table = table.drop("family1", "family2", "same_family", "family")
    if pair_col is None:
        return table.join(ref, F.upper("tf") == F.col("symbol__"), "left").withColumnRenamed("family__", "family").drop("symbol__")
    names = F.split(F.upper(pair_col), r"\|")
    out = table
    for k in (1, 2):
        own = ref.select(F.col("symbol__").alias(f"symbol{k}__"), F.col("family__").alias(f"family{k}"))
        out = out.withColumn(f"name{k}__", F.get(names, F.lit(k - 1))).join(small(own), F.col(f"name{k}__") == F.col(f"symbol{k}__"), "left").drop(f"name{k}__", f"symbol{k}__")
    same = F.when(_no_family(F.col("family1")) | _no_family(F.col("family2")), False).otherwise(F.col("family1") == F.col("family2"))
    return out.withColumn("same_family", same)


def dimer_keys(keys: DataFrame, names: DataFrame, key: str, col: str = "name") -> DataFrame:
    """The distinct keys ``a::b`` made of two of the names, without forming the names' product.

    A key is cut at every ``::``, as names may hold one themselves. Null keys and null names match nothing.
    """
    listed = small(names.select(F.col(col).alias("name__")).where("name__ is not null").distinct())
    own = keys.select(F.col(key).alias("key__")).where(F.col("key__").contains("::")).distinct()
    at = F.filter(F.sequence(F.lit(1), F.length("key__") - 1), lambda i: F.substr(F.col("key__"), i, F.lit(2)) == "::")
    cut = own.select("key__", F.explode(at).alias("at__"))
    ends = cut.select("key__", F.expr("substr(key__, 1, at__ - 1)").alias("a__"), F.expr("substr(key__, at__ + 2)").alias("b__"))
    for end in ("a__", "b__"):
        ends = ends.join(listed, F.col(end) == F.col("name__"), "left_semi")
    return ends.select(F.col("key__").alias(col)).distinct()


def is_listed(table: DataFrame, names: DataFrame, key: str, col: str = "name") -> DataFrame:
    """Rows whose key is among the names or is a dimer ``a::b`` of two of them."""
    listed = names.select(F.col(col).alias("name__")).unionByName(dimer_keys(table, names, key, col).select(F.col(col).alias("name__"))).distinct()
    return table.join(listed, F.col(key) == F.col("name__"), "left_semi")


def known_pairs(table: DataFrame, reference: DataFrame, pair_col: str = "tf_pair") -> DataFrame:
    """Adds is_ppi: 1 where the pair, in either order, is in the reference (TF1, TF2)."""
    ref = reference.select(canonical_pair(F.col("TF1"), F.col("TF2")).alias("known__")).distinct()
    names = F.split(pair_col, r"\|")
    key = canonical_pair(F.get(names, F.lit(0)), F.get(names, F.lit(1)))
    return table.withColumn("key__", key).join(ref, F.col("key__") == F.col("known__"), "left").withColumn("is_ppi", F.col("known__").isNotNull().cast("int")).drop("key__", "known__")


def recruiters(table: DataFrame, matrix: DataFrame, cofactors: list[str], pair_col: str = "tf_pair") -> DataFrame:
    """Adds count_{cofactor}: how many of the pair's two names recruit it (0, 1 or 2; a name twice counts twice)."""
    names = F.split(pair_col, r"\|")
    out = table
    for k in (1, 2):
        own = matrix.select(F.col("TF").alias(f"tf{k}__"), *[F.col(c).cast("int").alias(f"{c}_{k}__") for c in cofactors])
        out = out.join(small(own), F.get(names, F.lit(k - 1)) == F.col(f"tf{k}__"), "left").drop(f"tf{k}__")
    for c in cofactors:
        out = out.withColumn(f"count_{c}", F.coalesce(f"{c}_1__", F.lit(0)) + F.coalesce(f"{c}_2__", F.lit(0)))
    return out.drop(*[f"{c}_{k}__" for c in cofactors for k in (1, 2)])


def binding_pairs(matrix: DataFrame, prey: str = "prey") -> DataFrame:
    """(tf_pair, binds): the matrix melted to unordered pairs, the largest flag of either order."""
    baits = [c for c in matrix.columns if c != prey]
    long = matrix.select(prey, *[F.col(c).cast("string").alias(c) for c in baits]).unpivot([prey], baits, "bait", "value")
    return long.select(canonical_pair(F.col(prey), F.col("bait")).alias("tf_pair"), binding_flag(F.col("value")).alias("flag")).groupBy("tf_pair").agg(F.max("flag").alias("binds"))
