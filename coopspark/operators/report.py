"""The tables behind the report figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coopspark.functions.scalars import canonical_pair, minus_log10, name_prefix
from coopspark.operators.annotate import annotate_family, is_listed, recruiters
from coopspark.operators.quantiles import quantiles
from coopspark.operators.rankstats import rank_pass, with_p_values
from coopspark.operators.running import running_sum
from coopspark.operators.windows import rolling_means, with_neighbours
from coopspark.plans.stage import small, written


def not_independent(table: DataFrame) -> DataFrame:
    return table.where(F.col("cooperativity") != "Independent")


def in_order(table: DataFrame, score: str, key: str) -> DataFrame:
    """The rows that have a score, with ``place`` from 1 in the total order of score and key (null keys first); rows alike in both share the last place."""
    own = table.where(F.col(score).isNotNull()).withColumn("one__", F.lit(1).cast("bigint"))
    return running_sum(own, "one__", [score, key], name="place").drop("one__")


def histogram(table: DataFrame, value: str, bins: int = 50, group: list[str] | None = None) -> DataFrame:
    """(group..., bin, n): counts in equal bins between the least and the greatest value; empty bins are left out."""
    group = group or []
    range_ = table.agg(F.min(value).alias("low__"), F.max(value).alias("high__"))
    x = F.col(value)
    place = F.when(F.col("high__") > F.col("low__"), F.least(F.floor((x - F.col("low__")) / F.expr("nullif(high__ - low__, 0)") * bins), F.lit(bins - 1))).otherwise(0)
    return table.where(x.isNotNull()).crossJoin(F.broadcast(range_)).withColumn("bin", place.cast("int")).groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))


def ecdf(table: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, ecdf, median): distinct values with the share of rows up to them."""
    counted = table.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("rows__"))
    up = running_sum(counted, "rows__", [value], [group], name="upto__")
    totals = table.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("all__")).join(quantiles(table, value, {"median": 0.5}, [group]), group)
    return up.join(totals, group).select(group, value, (F.col("upto__") / F.col("all__")).alias("ecdf"), "median")


def box_stats(table: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group..., n, q1, median, q3, low, high, outliers): quartiles, whiskers at 1.5 quartile distances, rows beyond."""
    q = table.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    q = q.join(quantiles(table, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group), group)
    far = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - far) & (F.col(value) <= F.col("q3") + far)
    ends = table.where(F.col(value).isNotNull()).join(q, group).groupBy(*group).agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.sum((~inside).cast("bigint")).alias("outliers"))
    return q.join(ends, group)


def density(table: DataFrame, value: str, points: int = 200, group: list[str] | None = None, low: float = -1.0, high: float = 1.0, cells: int = 2000) -> DataFrame:
    """(group..., x, density): Gaussian density on a grid, bandwidth std * n**(-1/5).

    Values are first counted in ``cells`` cells of the range, so the sum over
    the grid costs cells x points for each group, however many rows it has.
    """
    group = group or []
    own = table.where(F.col(value).isNotNull())
    width = (high - low) / cells
    cell = F.floor((F.col(value) - low) / width)
    counted = own.groupBy(*group, cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    spread = own.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"))
    spread = spread.where("n > 1 and sd > 0").withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    grid = table.sparkSession.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("x"))
    centre = F.lit(low) + (F.col("cell") + 0.5) * width
    z = (F.col("x") - centre) / F.col("h")
    joined = (counted.join(spread, group) if group else counted.crossJoin(F.broadcast(spread))).crossJoin(F.broadcast(grid))
    return joined.groupBy(*group, "x").agg(F.sum(F.col("c") * F.exp(F.lit(-0.5) * z * z) / (F.col("n") * F.col("h") * F.lit(2.5066282746310002))).alias("density"))


def pair_against_null(pairs: DataFrame, a: str, b: str, track: int, dist_min: int, dist_max: int, p_values: str = "auto") -> DataFrame:
    """One row: D, U, p-values and median shift of one pair, in either orientation, against all pairs in the distance window."""
    value = F.col(f"interaction_t{track}").alias("value")
    key = "|".join(sorted((a, b)))
    is_own, is_null = canonical_pair(F.col("tf1"), F.col("tf2")) == key, (F.col("distance") > dist_min) & (F.col("distance") <= dist_max)
    read = written(pairs.select(value, is_own.alias("is_own"), is_null.alias("is_null")).where("is_own or is_null"))  # by ranks and medians: pairs may be scored as they are read
    own, null = read.where("is_own").select(F.lit(key).alias("name"), "value"), read.where("is_null").select("value")
    middle = quantiles(own, "value", {"own__": 0.5}).crossJoin(quantiles(null, "value", {"null__": 0.5}))
    return with_p_values(rank_pass(own, null), p_values).crossJoin(F.broadcast(middle)).withColumn("shift", F.col("own__") - F.col("null__")).drop("own__", "null__")


def decay(pairs: DataFrame, tracks: list[int], mode: str = "signed") -> DataFrame:
    """(track, sign, distance, mean): mean interaction by distance, of positive and negative values apart or of their size."""
    names = [f"interaction_t{k}" for k in tracks]
    long = pairs.unpivot(["distance"], names, "track", "value")
    if mode == "absolute":
        long = long.withColumn("value", F.abs("value")).withColumn("sign", F.lit("absolute"))
    else:
        long = long.withColumn("sign", F.when(F.col("value") > 0, "positive").when(F.col("value") < 0, "negative")).where("sign is not null")
    return long.groupBy("track", "sign", "distance").agg(F.avg("value").alias("mean"))


def prefix_matrix(table: DataFrame, pair_col: str = "tf_pair", value: str = "coop_score", prefixes: list[str] | None = None) -> DataFrame:
    """Mean score by name prefixes of the pair: long (prefix1, prefix2, mean), or wide with a column for each of ``prefixes``."""
    names = F.split(pair_col, r"\|")
    own = not_independent(table).withColumn("prefix1", name_prefix(F.get(names, F.lit(0)))).withColumn("prefix2", name_prefix(F.get(names, F.lit(1))))
    if prefixes is None:
        return own.groupBy("prefix1", "prefix2").agg(F.avg(value).alias("mean"))
    return own.groupBy("prefix1").pivot("prefix2", prefixes).agg(F.avg(value))


def compressed_labels(names: DataFrame, name: str, place: str, group: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``label``: of a run of names with the same prefix the first says the prefix and s, the others are blank; a run of one keeps its name.

    A null name is a run of its own. Names lie in range partitions along the
    axis, so a run may go through several of them.
    """
    near = with_neighbours(names, name_prefix(F.col(name)), [place, name], group, "before__", "after__", parts)
    prefix = name_prefix(F.col(name))
    joins = lambda other: F.coalesce(F.col(other)["value"] == prefix, F.lit(False))
    label = F.when(joins("before__"), "").when(joins("after__"), F.concat(prefix, F.lit("s"))).otherwise(F.col(name))
    return near.withColumn("label", label).drop("before__", "after__")


def top_share(pairs: DataFrame, top: int = 5, min_partners: int = 10, pair_col: str = "tf_pair", value: str = "abs_i_sum") -> DataFrame:
    """(tf, specificity_ratio): the share of a TF's ``top`` strongest partners in all, for TFs with ``min_partners``."""
    names = F.split(pair_col, r"\|")
    a, b = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    both = pairs.select(F.explode(F.array(F.struct(a.alias("tf"), b.alias("partner")), F.struct(b.alias("tf"), a.alias("partner")))).alias("p"), F.col(value).alias("v")).select("p.tf", "p.partner", "v")
    order = Window.partitionBy("tf").orderBy(F.desc("v"), "partner")
    ranked = both.withColumn("place", F.row_number().over(order))
    out = ranked.groupBy("tf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("place") <= top, F.col("v"))).alias("t"), F.sum("v").alias("s"))
    return out.where(F.col("n") >= min_partners).select("tf", F.expr("try_divide(t, s)").alias("specificity_ratio"))


def enrichment_curve(table: DataFrame, p: str = "ks_p", flag: str = "is_ppi", key: str = "tf_pair") -> DataFrame:
    """Adds place, cumulative hits and both in percent, in the order of p. Without a hit the percentages are null."""
    order = Window.orderBy(p, key)
    everything = Window.partitionBy()
    own = table.withColumn("place", F.row_number().over(order)).withColumn("cum_ppi_count", F.sum(flag).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total, n = F.sum(flag).over(everything), F.count(F.lit(1)).over(everything)
    return own.withColumn("pct_total_pairs", F.when(total > 0, F.col("place") * 100.0 / n)).withColumn("pct_ppi_found", F.when(total > 0, F.col("cum_ppi_count") * 100.0 / total))


def specificity_trend(table: DataFrame, width: int = 50, score: str = "coop_score", gini: str = "gini", key: str = "tf") -> DataFrame:
    """Quartile flags of ``gini`` and their rolling means along the score."""
    own = table.where(F.col(gini).isNotNull() & F.col(score).isNotNull())
    cuts = quantiles(own, gini, {"high__": 0.75, "low__": 0.25})
    flagged = own.crossJoin(F.broadcast(cuts)).withColumn("is_specific", (F.col(gini) >= F.col("high__")).cast("int")).withColumn("is_ubiquitous", (F.col(gini) <= F.col("low__")).cast("int")).drop("high__", "low__")
    return rolling_means(flagged, {"rolling_spec": "is_specific", "rolling_ubiq": "is_ubiquitous"}, [score, key], width)


def most_frequent(table: DataFrame, col: str, n: int) -> DataFrame:
    """Rows of the n most frequent values (ties by value)."""
    top = table.groupBy(col).agg(F.count(F.lit(1)).alias("n__")).orderBy(F.desc("n__"), col).limit(n).select(col)
    return table.join(F.broadcast(top), col, "left_semi")


def specificity_by_class(pairs: DataFrame, tfs: DataFrame, top: int = 5, min_partners: int = 10) -> DataFrame:
    """(tf, cooperativity, specificity_ratio) of TFs that aren't independent: what ``top_share`` gives, by class."""
    classes = not_independent(tfs).select("tf", "cooperativity")
    return top_share(pairs, top, min_partners).where("specificity_ratio is not null").join(small(classes), "tf").select("tf", "cooperativity", "specificity_ratio")


def scored(table: DataFrame) -> DataFrame:
    """Rows with a score."""
    return table.where(F.col("coop_score").isNotNull())


def monomers(pairs: DataFrame) -> DataFrame:
    """Pairs without a dimer."""
    return pairs.where(~F.coalesce(F.col("tf_pair").contains("::"), F.lit(False)))


def motif_gc_by_class(tfs: DataFrame, gc: DataFrame) -> DataFrame:
    """(cooperativity, box statistics of gc) for TFs with a known motif (tf, gc); a TF with several motifs counts with each."""
    return box_stats(tfs.select("tf", "cooperativity").join(small(gc.select("tf", "gc")), "tf"), "gc", ["cooperativity"])


def coop_by_same_family(pairs: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Densities (same_family, x, density) of the scores, and one row (n, n0, mw_u, mw_p, ...) of pairs within families against the others."""
    own = written(annotate_family(scored(pairs), families).select("same_family", "coop_score"))
    own = own.withColumn("same_family", F.coalesce("same_family", F.lit(False)))
    same = own.where("same_family").select(F.lit("same").alias("name"), F.col("coop_score").alias("value"))
    test = with_p_values(rank_pass(same, own.where("not same_family").select(F.col("coop_score").alias("value"))).where("n > 1 and n0 > 1"))
    return density(own, "coop_score", group=["same_family"]), test


def coop_by_family(tfs: DataFrame, families: DataFrame, top: int = 15) -> DataFrame:
    """(family, box statistics of the score) of the ``top`` families with most TFs."""
    own = annotate_family(scored(tfs), families, None).where("family is not null")
    return box_stats(most_frequent(own, "family", top), "coop_score", ["family"])


def intra_family(pairs: DataFrame, families: DataFrame, min_pairs: int = 10) -> DataFrame:
    """(family1, box statistics of the score) of pairs within one family, for families with ``min_pairs`` of them."""
    own = annotate_family(scored(pairs), families).where("same_family and family1 is not null")
    return box_stats(own, "coop_score", ["family1"]).where(F.col("n") >= min_pairs)


def listed_ecdf(tfs: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """(kind, coop_score, ecdf, median): the scores of TFs on each list (name), dimers of two listed names included."""
    parts = [is_listed(scored(tfs).select("tf", "coop_score"), names, "tf").select(F.lit(kind).alias("kind"), "coop_score") for kind, names in lists.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return ecdf(out, "coop_score", "kind")


def cell_specificity(tfs: DataFrame, dispersion: DataFrame, width: int = 50) -> DataFrame:
    """(tf, coop_score, gini, is_specific, is_ubiquitous, rolling_spec, rolling_ubiq) of TFs with a dispersion (symbol, gini)."""
    own = scored(tfs).select("tf", "coop_score").join(small(dispersion.select(F.col("symbol").alias("tf"), "gini")), "tf")
    return specificity_trend(own, width)


def cofactor_recruitment(pairs: DataFrame, matrix: DataFrame, cofactors: list[str] | None = None) -> DataFrame:
    """(cofactor, recruiters, box statistics of the score): how many of a pair's TFs recruit it; cofactors with one level only are left out."""
    names = cofactors or [c for c in matrix.columns if c != "TF"]
    counted = recruiters(monomers(scored(pairs)), matrix, names)
    long = counted.unpivot(["coop_score"], [f"count_{c}" for c in names], "cofactor", "recruiters").withColumn("cofactor", F.expr("substring(cofactor, 7)"))
    levels = long.groupBy("cofactor").agg(F.countDistinct("recruiters").alias("k")).where("k > 1")
    return box_stats(long.join(small(levels), "cofactor", "left_semi"), "coop_score", ["cofactor", "recruiters"])


def dna_mediated(pairs: DataFrame, binding: DataFrame) -> DataFrame:
    """(measure, binds, box statistics) of the score and of -log10(ks_p), for pairs in ``binding`` (tf_pair, binds)."""
    own = pairs.join(small(binding.select("tf_pair", "binds")), "tf_pair").select("binds", "coop_score", minus_log10(F.col("ks_p")).alias("minus_log10_ks_p"))
    long = own.unpivot(["binds"], ["coop_score", "minus_log10_ks_p"], "measure", "value")
    return box_stats(long, "value", ["measure", "binds"])
