"""Attribution filter, TF importance and cooperativity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coopspark.functions.scalars import canonical_pair
from coopspark.operators.quantiles import quantiles, sketched
from coopspark.operators.rankstats import benjamini_hochberg, rank_pass, signed_ks, with_p_values
from coopspark.plans.stage import small, written


def sliced(scores: Column, start: Column, end: Column) -> Column:
    """Entries start..end-1 of a score array, clipped at its end."""
    return F.slice(scores, (start + 1).cast("int"), F.greatest(F.least(end, F.size(scores)) - start, F.lit(0)).cast("int"))


def second_largest(values: Column) -> Column:
    """Second largest entry; null with fewer than two."""
    return F.get(F.sort_array(values, asc=False), F.lit(1))


def attribution_threshold(gaps: DataFrame, scores: DataFrame, percentile: float, sketch: int | None = None) -> DataFrame:
    """(track, threshold) from all positions of all gaps: gaps (region, gap_start_rel, gap_end_rel), scores (region, track, scores).

    Exact by counts of all values; with ``sketch``, the parameter of a KLL
    sketch, only sketches are shuffled and the rank is off by ``rank_error(sketch)`` at most.
    """
    values = gaps.join(scores, "region").select("track", F.explode(sliced(F.col("scores"), F.col("gap_start_rel"), F.col("gap_end_rel"))).alias("v"))
    at = {"threshold": percentile / 100.0}
    return quantiles(values, "v", at, ["track"]) if sketch is None else sketched(values, "v", at, ["track"], sketch)


def attribution_filter(motifs: DataFrame, scores: DataFrame, thresholds: DataFrame, tracks: list[int]) -> DataFrame:
    """``motifs`` with second_max_t{k} and pass_threshold_t{k}; rows that pass on some track.

    ``scores`` has one row for each region and track; they come as one row a region.
    """
    wide = scores.groupBy("region").pivot("track", tracks).agg(F.first("scores"))
    limits = thresholds.groupBy().pivot("track", tracks).agg(F.first("threshold"))  # one row
    limits = limits.select(*[F.col(str(k)).alias(f"limit{k}") for k in tracks])
    out = motifs.join(wide, "region").crossJoin(F.broadcast(limits))
    for k in tracks:
        out = out.withColumn(f"second_max_t{k}", second_largest(sliced(F.col(str(k)), F.col("start_rel"), F.col("end_rel"))))
        out = out.withColumn(f"pass_threshold_t{k}", F.coalesce((F.col(f"second_max_t{k}") > F.col(f"limit{k}")).cast("int"), F.lit(0)))
    some = F.exists(F.array(*[f"pass_threshold_t{k}" for k in tracks]), lambda p: p == 1)
    return out.where(some).drop(*[str(k) for k in tracks], *[f"limit{k}" for k in tracks])


def tf_importance(single: DataFrame, tracks: list[int], min_count: int) -> DataFrame:
    """(tf, count, and for each track mean, median and signed KS).

    Track k's mean and median use the rows that pass tracks 0 to k; the KS
    compares all rows of the TF with all rows.
    """
    aggregates, medians, passing = [F.count(F.lit(1)).alias("count")], [], F.lit(True)
    for k in tracks:
        passing = passing & (F.col(f"pass_threshold_t{k}") == 1)
        kept = F.when(passing, F.col(f"isa_t{k}"))
        aggregates.append(F.avg(kept).alias(f"mean_isa_t{k}"))
        medians.append(quantiles(single.where(passing), f"isa_t{k}", {f"median_isa_t{k}": 0.5}, ["tf"]))
    out = single.groupBy("tf").agg(*aggregates)
    for median in medians:
        out = out.join(median, "tf", "left")
    for k in tracks:
        out = out.join(signed_ks(single, "tf", f"isa_t{k}", min_count).withColumnRenamed("ks", f"ks_isa_t{k}"), "tf", "left")
    return out


def positive_interactions(pairs: DataFrame, track: int) -> DataFrame:
    """Both motifs activate, and together more than each alone."""
    a, b, both = (F.col(f"{c}_t{track}") for c in ("isa1", "isa2", "isa_both"))
    return pairs.where((a > 0) & (b > 0) & (both > a) & (both > b))


def passing_pairs(pairs: DataFrame, track: int) -> DataFrame:
    """Pairs whose motifs both pass the track's floor, names in order, rows alike once."""
    own = pairs.where((F.col(f"tf1_pass_threshold_t{track}") == 1) & (F.col(f"tf2_pass_threshold_t{track}") == 1))
    return own.withColumns({"tf1": F.least("tf1", "tf2"), "tf2": F.greatest("tf1", "tf2")}).distinct()


def named_values(pairs: DataFrame, level: str, track: int) -> DataFrame:
    """(name, value, distance) by pair, or by TF, where each pair counts for both of its names."""
    value = F.col(f"interaction_t{track}").alias("value")
    if level == "tf_pair":
        return pairs.select(canonical_pair(F.col("tf1"), F.col("tf2")).alias("name"), value, "distance")
    if level == "tf":
        return pairs.select(F.explode(F.array("tf1", "tf2")).alias("name"), value, "distance")
    raise ValueError("level must be tf_pair or tf")


def group_sums(values: DataFrame, min_count: int) -> DataFrame:
    """(name, abs_i_sum, coop_score, count, mean_distance) of groups of at least ``min_count`` rows."""
    sums = values.groupBy("name").agg(F.sum("value").alias("s"), F.sum(F.abs("value")).alias("a"), F.count(F.lit(1)).alias("count"), F.avg("distance").alias("mean_distance")).where(F.col("count") >= min_count)
    return sums.select("name", F.round("a", 4).alias("abs_i_sum"), F.round(F.when(F.col("a") > 0, F.expr("try_divide(s, a)")).otherwise(0.0), 4).alias("coop_score"), "count", "mean_distance")


def assign_classes(table: DataFrame, q_threshold: float = 0.1, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Adds ``cooperativity`` from ks_q and the quantiles of the significant scores."""
    significant = F.col("ks_q") < q_threshold
    limits = table.agg(F.percentile(F.when(significant, F.col("coop_score")), F.array(F.lit(low), F.lit(high))).alias("limits"))
    score = F.col("coop_score")
    named = F.when(score > F.get("limits", F.lit(1)), "Synergistic").when(score < F.get("limits", F.lit(0)), "Redundant").otherwise("Intermediate")
    return table.crossJoin(F.broadcast(limits)).withColumn("cooperativity", F.when(significant, named).otherwise("Independent")).drop("limits")


def cooperativity(pairs: DataFrame, level: str, dist_min: int, dist_max: int, track: int = 0, min_count: int = 10, q_threshold: float = 0.1, p_values: str = "auto") -> DataFrame:
    """The cooperativity table of one track at pair or TF level.

    The null are the positive interactions at distances in (dist_min, dist_max].
    An empty input, null or result gives an empty table. The named values and
    the tested table are written: null, sums, groups and class limits read each.
    """
    positive = positive_interactions(passing_pairs(pairs, track), track)
    positive = written(positive.select("tf1", "tf2", f"interaction_t{track}", "distance"))
    null = positive.where((F.col("distance") > dist_min) & (F.col("distance") <= dist_max)).select(F.col(f"interaction_t{track}").alias("value"))
    values = named_values(positive, level, track)
    sums = written(group_sums(values, min_count))
    stats = with_p_values(rank_pass(values.join(small(sums.select("name")), "name", "left_semi"), null), p_values)
    table = sums.join(stats, "name").select("name", "abs_i_sum", "coop_score", "ks_p", F.round("ks_d", 6).alias("ks_d"), "mw_p", F.round("mw_u", 6).alias("mw_d"), "mw_z", "p_method", "mw_method", "count", "mean_distance")
    table = written(benjamini_hochberg(benjamini_hochberg(written(table), "ks_p", "ks_q", "name"), "mw_p", "mw_q", "name"))
    return assign_classes(table, q_threshold).withColumnRenamed("name", level)
