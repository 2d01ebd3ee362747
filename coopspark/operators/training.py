"""Training tables: sampling, balancing, splits, labels, metrics and a two-head model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coopspark.functions.scalars import class_label, regression_target
from coopspark.functions.sequence import both_strands
from coopspark.operators.intervals import resize_regions, signal_by_region
from coopspark.operators.quantiles import quantiles
from coopspark.operators.selection import first_rows
from coopspark.operators.sequences import sequences_of
from coopspark.plans.stage import written


def hash_order(keys: list[str], seed: int) -> Column:
    """A text to sort by: MD5 of the keys and the seed, the same in every engine."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed))).cast("binary"))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows (all, if fewer), first in hash order: a filter by the n-th key, which counts find, so no task holds the sample."""
    return first_rows(df, n, keys, hash_order(keys, seed))


def shuffled(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """All rows in hash order."""
    return df.orderBy(hash_order(keys, seed), *keys)


def balanced(positives: DataFrame, negatives: DataFrame, pool: DataFrame, length: int, seed: int = 42) -> DataFrame:
    """As many negatives as positives: topped up from the resized pool (targets 0), or sampled down."""
    keys = ["chrom", "start", "end"]
    n_pos, n_neg = positives.count(), negatives.count()
    if n_pos > n_neg:
        extra = sample_rows(resize_regions(pool, length), n_pos - n_neg, keys, seed)
        more = extra.select(*keys, F.lit(0.0).alias("target_reg"), F.lit(0.0).alias("target_class"))
        return positives.unionByName(negatives, allowMissingColumns=True).unionByName(more, allowMissingColumns=True)
    return positives.unionByName(sample_rows(negatives, n_pos, keys, seed), allowMissingColumns=True)


def split_of(chrom: Column, keys: list[str], holdout: str = "chr2") -> Column:
    """test on the held-out chromosome; elsewhere val for about 15 % by a hash prefix (da of 100 in hex is 85 %), else train."""
    place = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary")), 1, 2)
    return F.when(chrom == holdout, "test").when(place < "da", "train").otherwise("val")


def labelled(regions: DataFrame, signal: DataFrame | None = None, threshold: float | DataFrame | None = None, class_col: str | None = None) -> DataFrame:
    """Adds target_reg and target_class: by a threshold (a number, or one row with that column), by a given column, or by any signal."""
    own = regions if signal is None else signal_by_region(regions, signal).withColumnRenamed("signal", "target_reg")
    value = F.coalesce("target_reg", F.lit(0.0))
    if isinstance(threshold, DataFrame):
        own = own.crossJoin(F.broadcast(threshold.select(F.col("threshold").alias("limit__"))))  # one row
        kind = F.coalesce((value > F.col("limit__")).cast("double"), F.lit(0.0))
    else:
        kind = F.col(class_col).cast("float").cast("double") if class_col else class_label(value, threshold if threshold is not None else 0.0)
    return own.withColumn("target_reg", value).withColumn("target_class", kind).drop("limit__")


def noise_threshold(background: DataFrame, signal: DataFrame, length: int, percentile: float = 99.0, n: int = 50_000, seed: int = 42) -> DataFrame:
    """One row (threshold): a percentile of the signal of n sampled background regions; null without any."""
    drawn = resize_regions(sample_rows(background, n, ["chrom", "start", "end"], seed), length)
    return written(quantiles(signal_by_region(drawn, signal), "signal", {"threshold": percentile / 100.0}))


def get_expressed_tfs(promoters: DataFrame, background: DataFrame, signal: DataFrame, length: int = 1000, percentile: float = 99.0, n: int = 50_000, seed: int = 42) -> DataFrame:
    """(name) in order: names of promoters (chrom, start, end, name) with more signal than the noise threshold."""
    limit = noise_threshold(background, signal, length, percentile, n, seed)
    measured = signal_by_region(resize_regions(promoters.select("chrom", "start", "end", "name"), length), signal)
    return measured.crossJoin(F.broadcast(limit)).where("signal > threshold").select("name").distinct().orderBy("name")


def training_rows(table: DataFrame, genome: DataFrame | Callable[[DataFrame], DataFrame], tile_width: int, reverse: bool = True) -> DataFrame:
    """(split, seq, target_reg_log, target_class, is_rc): each region's sequence and, if asked, its reverse complement."""
    rows = sequences_of(table, genome, tile_width).select("split", "seq", regression_target(F.col("target_reg")).alias("target_reg_log"), "target_class")
    # Both strands of a row side by side: a union would fetch every sequence twice. So would a filter before they are made.
    strands = both_strands("seq") if reverse else F.array("seq")
    both = rows.select("split", "target_reg_log", "target_class", F.posexplode(strands).alias("strand", "seq")).where("seq is not null")
    return both.select("split", "seq", "target_reg_log", "target_class", (F.col("strand") == 1).alias("is_rc"))


def compile_training_data(
    regions: DataFrame,
    genome: DataFrame | Callable[[DataFrame], DataFrame],
    signal: DataFrame | None,
    pool: DataFrame,
    length: int,
    tile_width: int,
    threshold: float | None = None,
    holdout: str = "chr2",
    seed: int = 42,
    target_col: str | None = None,
    class_col: str | None = None,
    percentile: float = 99.0,
    background: int = 50_000,
) -> DataFrame:
    """Resize, label, balance, split and fetch sequences: the rows for the training-set sink.

    ``genome`` is as in ``sequences_of``. Labels come from signal tracks, by ``threshold`` or, if it is None, by the
    noise threshold of the pool; or from the column ``target_col`` of the
    regions, with classes in ``class_col`` or else wherever there is signal.
    """
    wide = resize_regions(regions, length)
    if signal is not None:
        limit = threshold if threshold is not None else noise_threshold(pool, signal, length, percentile, background, seed)
        table = labelled(wide, signal, limit)
    elif target_col is not None:
        table = labelled(wide.withColumn("target_reg", F.col(target_col).cast("double")), None, threshold, class_col)
    else:
        raise ValueError("regions need signal tracks or a column with the signal")
    # Counts, samples and rows read the labelled regions several times: they are measured once.
    table = written(table.select("chrom", "start", "end", "target_reg", "target_class"))
    even = balanced(table.where("target_class = 1"), table.where("target_class <> 1"), pool, length, seed)
    return training_rows(even.withColumn("split", split_of(F.col("chrom"), ["chrom", "start", "end"], holdout)), genome, tile_width)


def metrics(predictions: DataFrame, group: list[str]) -> DataFrame:
    """(group..., n, mse, bce, loss, pearson, accuracy) from p_reg, y_reg, z_class (a logit) and y_class."""
    z, y = F.col("z_class"), F.col("y_class")
    bce = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    out = predictions.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p_reg") - F.col("y_reg"), F.lit(2.0))).alias("mse"), F.avg(bce).alias("bce"), F.corr("p_reg", "y_reg").alias("pearson"), F.avg(((z > 0) == (y > 0.5)).cast("double")).alias("accuracy"))
    return out.withColumn("loss", F.col("mse") + F.col("bce")).withColumn("pearson", F.when(F.col("n") > 2, F.col("pearson")))


def fit_two_heads(train: DataFrame, k: int = 3, features: int = 64, trees: int = 20, depth: int = 3, seed: int = 42, val: DataFrame | None = None, min_delta: float = 0.001) -> list:
    """Spark ML on hashed k-mers: boosted trees for the signal and for the class. Returns (pipeline model, column) for each track.

    With ``val``, boosting ends with the round after which the validation error
    falls by less than ``min_delta`` of itself, and keeps the best round's trees.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, SQLTransformer
    from pyspark.ml.regression import GBTRegressor

    words = SQLTransformer(statement=f"SELECT *, CASE WHEN length(seq) > {k} THEN regexp_extract_all(seq, '(?s)(?=(.{{{k}}}))', 1) ELSE array(seq) END AS kmers__ FROM __THIS__")
    counts = HashingTF(inputCol="kmers__", outputCol="kmer_counts__", numFeatures=features)
    checked = val is not None and not val.isEmpty()
    rows = train.withColumn("val__", F.lit(False))
    if checked:
        rows = rows.unionByName(val.withColumn("val__", F.lit(True)))
    # Both heads and all their rounds read the counts: they are made once.
    rows = written(counts.transform(words.transform(rows)).select("kmer_counts__", "target_reg_log", "target_class", "val__"))
    out = []
    for label, name in (("target_reg_log", "p_reg__"), ("target_class", "p_class__")):
        tree = GBTRegressor(featuresCol="kmer_counts__", labelCol=label, predictionCol=name, maxIter=trees, maxDepth=depth, seed=seed, validationTol=min_delta)
        if checked:
            tree = tree.setValidationIndicatorCol("val__")
        out.append((PipelineModel([words, counts, tree.fit(rows)]), name))
    return out


def learning_curve(heads: list, stages: dict[str, DataFrame]) -> DataFrame:
    """(head, stage, round, mse): the error of each head after each round of boosting, on each named table."""
    rows = []
    spark = next(iter(stages.values())).sparkSession
    for model, name in heads:
        *before, boosted = model.stages
        for stage, df in stages.items():
            for step in before:
                df = step.transform(df)
            head = "reg" if name == "p_reg__" else "class"
            rows += [(head, stage, k + 1, float(e)) for k, e in enumerate(boosted.evaluateEachIteration(df, "squared"))]
    return spark.createDataFrame(rows, "head string, stage string, round int, mse double")
