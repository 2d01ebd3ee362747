"""The three entry points: train, ablate, report. Stages are tables; heavy ones are written between stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coopspark.functions.scalars import dimer_parts, region_id
from coopspark.operators import ablation, annotate, coop, intervals, rankstats, report, training
from coopspark.operators.sequences import sequences_of
from coopspark.plans.ledger import Ledger
from coopspark.plans.stage import scratch_dir
from coopspark.schemas import CATEGORIES
from coopspark.sources.sinks import TRAINING, read_training_set, write_training_set


@dataclass
class QuickStart:
    """Parameters shared by the stages; ``predictor`` is any object with ``score(df, seq_col, out)``."""

    spark: SparkSession
    genome: DataFrame
    tile_width: int
    predictor: ablation.Predictor | None = None
    seq_len: int = 600
    tracks: list[int] = field(default_factory=lambda: [0])
    dist_min: int = 100
    dist_max: int = 255
    min_count: int = 10
    q_threshold: float = 0.1
    p_values: str = "auto"
    model_version: str = ""
    curve: DataFrame | None = field(default=None, repr=False)  # (head, stage, round, mse) of the last training

    def train(self, regions: DataFrame, signal: DataFrame | None, pool: DataFrame, path: str | None = None, threshold: float | None = None, holdout: str = "chr2", target_col: str | None = None, class_col: str | None = None) -> tuple[ablation.Predictor, DataFrame]:
        """Compile and write the training set, fit the two heads, and return them with test metrics. Labels are as in ``compile_training_data``."""
        path = path or scratch_dir(self.spark)
        rows = training.compile_training_data(regions, self.genome, signal, pool, self.seq_len, self.tile_width, threshold, holdout, target_col=target_col, class_col=class_col)
        write_training_set(rows, path)
        train, val = (read_training_set(self.spark, path, name, TRAINING) for name in ("train", "val"))
        if train.isEmpty():
            raise ValueError("there is nothing to train on: no region is above the threshold, or none outside the held-out chromosome")
        heads = training.fit_two_heads(train, val=val)
        self.curve = training.learning_curve(heads, {"train": train} if val.isEmpty() else {"train": train, "val": val})
        self.predictor = ablation.MLPredictor(heads)
        test = self.predictor.score(read_training_set(self.spark, path, "test", TRAINING), "seq", "p")
        named = test.select(F.get("p", F.lit(0)).alias("p_reg"), F.col("target_reg_log").alias("y_reg"), (F.get("p", F.lit(1)) - 0.5).alias("z_class"), F.col("target_class").alias("y_class"), F.lit("test").alias("split"))
        return self.predictor, training.metrics(named, ["split"])

    @staticmethod
    def map_motifs(regions: DataFrame, hits: DataFrame, min_score: int = 500, expressed: DataFrame | None = None, peaks: DataFrame | None = None, width: int = 1000) -> DataFrame:
        """Hits inside regions with relative coordinates, filtered by score, by expressed names and, if peaks are given, flagged by evidence."""
        own = hits.where(F.col("score") >= min_score).withColumn("tf", F.upper("tf"))
        if expressed is not None:
            # A hit stays if none of its parts is missing from the list.
            names = expressed.select(F.upper("name").alias("part")).distinct()
            parts = own.select("tf").distinct().select("tf", F.explode(dimer_parts(F.col("tf"))).alias("part"))
            own = own.join(parts.join(names, "part", "left_anti").select("tf"), "tf", "left_anti")
        met = intervals.contained(regions.select("chrom", "start", "end"), own.select("chrom", "start", "end", "tf", "score", "strand"), width)
        out = met.select("chrom", F.col("start_hit").alias("start"), F.col("end_hit").alias("end"), (F.col("start_hit") - F.col("start")).alias("start_rel"), (F.col("end_hit") - F.col("start")).alias("end_rel"), F.col("tf_hit").alias("tf"), F.col("score_hit").alias("score"), F.col("strand_hit").alias("strand"), region_id(F.col("chrom"), F.col("start"), F.col("end")).alias("region"), F.col("start").alias("region_start"), F.col("end").alias("region_end"))
        if peaks is not None:
            flags = intervals.chip_evidence(out.select("region", "chrom", "region_start", "region_end", "tf").distinct(), peaks, width)
            out = out.join(flags.select("region", "tf", "evidence"), ["region", "tf"])
        return out

    def run_isa(self, regions: DataFrame, hits: DataFrame, percentile: float = 70.0, min_score: int = 500, expressed: DataFrame | None = None, peaks: DataFrame | None = None, window: int = 10, path: str | None = None) -> dict[str, DataFrame]:
        """Motifs, single and pair ablation, importance and cooperativity tables.

        With ``path`` every stage is kept there, and a later call finds those
        whose parameters and inputs are the same (models are told apart by
        ``model_version``): a run that broke off goes on after its last stage.
        """
        ledger = Ledger(self.spark, path)
        stage = ledger.stage
        settings = {"model": self.model_version, "predictor": type(self.predictor).__name__, "tracks": self.tracks}

        def mapped() -> DataFrame:
            met = self.map_motifs(regions, hits, min_score, expressed, peaks)
            return met.where("evidence") if peaks is not None else met

        motifs = stage("mapped", mapped, {"min_score": min_score}, inputs=(regions, hits, expressed, peaks))
        wanted = motifs.select("region", "chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end")).distinct()
        sequences = stage("sequences", lambda: sequences_of(wanted, self.genome, self.tile_width).where("seq is not null").select("region", "seq"), {"tile": self.tile_width}, ("mapped",), (self.genome,))
        scores = stage("scores", lambda: ablation.occlusion_scan(sequences, self.predictor, window, window), {**settings, "window": window}, ("sequences",))

        def filtered() -> DataFrame:
            gaps = intervals.subtract(wanted, motifs.select("chrom", "start", "end"))
            gaps = gaps.select(region_id(F.col("chrom"), F.col("start"), F.col("end")).alias("region"), (F.col("gap_start") - F.col("start")).alias("gap_start_rel"), (F.col("gap_end") - F.col("start")).alias("gap_end_rel"))
            return coop.attribution_filter(motifs, scores, coop.attribution_threshold(gaps, scores, percentile), self.tracks)

        kept = stage("motifs", filtered, {"percentile": percentile, "tracks": self.tracks}, ("mapped", "scores"))
        original = stage("original", lambda: ablation.original_scores(sequences, self.predictor), settings, ("sequences",))
        masks = stage("masks", lambda: ablation.single_scores(kept, sequences, self.predictor, original), settings, ("motifs", "sequences", "original"))
        single = stage("single", lambda: ablation.single_ablation(kept, sequences, self.predictor, self.tracks, masks), settings, ("motifs", "masks"))
        pairs = stage("pairs", lambda: ablation.pair_ablation(kept, sequences, self.predictor, self.tracks, self.dist_max, None, original, masks), {**settings, "dist_max": self.dist_max}, ("motifs", "masks"))
        out = {"motifs": kept, "single": single, "pairs": pairs}
        out["importance"] = stage("importance", lambda: coop.tf_importance(single, self.tracks, self.min_count), {"tracks": self.tracks, "min_count": self.min_count}, ("single",))
        tests = {"dist": [self.dist_min, self.dist_max], "min_count": self.min_count, "q": self.q_threshold, "p": self.p_values}
        for k in self.tracks:
            for level in ("tf_pair", "tf"):
                name = f"coop_{level}_t{k}"
                out[name] = stage(name, lambda level=level, k=k: coop.cooperativity(pairs, level, self.dist_min, self.dist_max, k, self.min_count, self.q_threshold, self.p_values), tests, ("pairs",))
        return out

    def report(self, tables: dict[str, DataFrame], track: int = 0, families: DataFrame | None = None, known: DataFrame | None = None, references: dict[str, DataFrame] | None = None, lists: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """Report tables of one track; those whose inputs are missing are left out.

        ``families`` (symbol, family) and ``known`` (TF1, TF2) are as in
        ``annotate``. ``references`` may hold ``gc`` (tf, gc), ``domains``
        (symbol, family), ``dispersion`` (symbol, gini), ``cofactors`` (TF and
        0/1 columns) and ``binding`` (tf_pair, binds); ``lists`` names lists of TFs.
        """
        out: dict[str, DataFrame] = {}
        refs = references or {}
        pairs, by_pair, by_tf = (tables.get(n) for n in ("pairs", f"coop_tf_pair_t{track}", f"coop_tf_t{track}"))
        if pairs is not None:
            null = pairs.where((F.col("distance") > self.dist_min) & (F.col("distance") <= self.dist_max))
            out["null"] = report.density(null, f"interaction_t{track}")
            out["decay"] = report.decay(pairs, [track])
        if by_pair is not None:
            out["histogram"] = report.histogram(report.not_independent(by_pair), "coop_score", 50, ["cooperativity"])
            out["heatmap"] = report.prefix_matrix(by_pair)
            out["distance"] = report.box_stats(by_pair, "mean_distance", ["cooperativity"])
            out["distance_tests"] = rankstats.adjacent_tests(by_pair, "cooperativity", "mean_distance", CATEGORIES, self.p_values)
            out["specificity"] = report.top_share(by_pair)
            if families is not None:
                out["families"] = annotate.annotate_family(by_pair, families)
                out["same_family"], out["same_family_test"] = report.coop_by_same_family(by_pair, families)
                out["intra_family"] = report.intra_family(by_pair, families)
            if known is not None:
                out["enrichment"] = report.enrichment_curve(annotate.known_pairs(report.monomers(report.scored(by_pair)), known))
            if "cofactors" in refs:
                out["cofactor_recruitment"] = report.cofactor_recruitment(by_pair, refs["cofactors"])
            if "binding" in refs:
                out["dna_mediated"] = report.dna_mediated(by_pair, refs["binding"])
        if by_tf is not None:
            if "importance" in tables:
                joined = by_tf.drop("count").join(tables["importance"], "tf").withColumn("independent", F.col("cooperativity") == "Independent")
                out["importance"] = rankstats.pearson(joined, "coop_score", f"mean_isa_t{track}", ["independent"])
            if by_pair is not None:
                own = report.specificity_by_class(by_pair, by_tf)
                out["specificity_by_class"] = report.density(own, "specificity_ratio", group=["cooperativity"], low=0.0)
            if "gc" in refs:
                out["motif_gc"] = report.motif_gc_by_class(by_tf, refs["gc"])
            if "domains" in refs or families is not None:
                out["coop_by_family"] = report.coop_by_family(by_tf, refs.get("domains", families))
            if "dispersion" in refs:
                out["cell_specificity"] = report.cell_specificity(by_tf, refs["dispersion"])
            if lists:
                out["listed"] = report.listed_ecdf(by_tf, lists)
        return out
