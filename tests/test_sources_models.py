"""FASTA by byte ranges, list readers, sketches, and boosting that stops by validation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coopspark.operators import coop, training
from coopspark.operators.quantiles import quantiles, rank_error, sketched
from coopspark.sources import readers


@pytest.mark.parametrize("split", [50, 97, 1000, 1 << 20])
def test_fasta_at_any_split(spark, tmp_path, split):
    rng = random.Random(1)
    contigs = {f"chr{k}": "".join(rng.choice("ACGTacgtN") for _ in range(n)) for k, n in enumerate([1, 700, 59, 60, 61, 0, 3000])}
    for number, names in enumerate((["chr0", "chr1", "chr2"], ["chr3", "chr4", "chr5", "chr6"])):
        with open(tmp_path / f"{number}.fa", "w") as f:
            f.write("; no contig yet\n" if number else "")
            for n in names:
                f.write(f">{n} some words\n")
                f.writelines(contigs[n][a : a + 60] + ("  \n" if a % 120 else "\n") for a in range(0, len(contigs[n]), 60))
                f.write("\n" if n == "chr1" else "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        tiles = readers.read_fasta(spark, str(tmp_path), 100)
        got = {(r.chrom, r.tile): r.seq for r in tiles.collect()}
        ranges = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(n, a // 100): s[a : a + 100] for n, s in contigs.items() for a in range(0, len(s), 100)}
    assert split > 100 or ranges > 3 * len(contigs)  # a contig lies in several tasks


def test_list_readers(spark, tmp_path):
    (tmp_path / "pairs").write_text("TF1\tTF2\tx\nA\tB\t1\nC\t\t2\n")
    assert [tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "pairs")).collect()] == [("A", "B"), ("C", None)]
    (tmp_path / "gini").write_text("symbol\tgini\tother\nA\t0.5\t1\nB\tNA\t2\n")
    assert [tuple(r) for r in readers.read_dispersion(spark, str(tmp_path / "gini")).collect()] == [("A", 0.5), ("B", None)]
    (tmp_path / "matrix").write_text("prey,X,Y\nA,0, 0.5\nB,,1\n")
    matrix = readers.read_matrix(spark, str(tmp_path / "matrix"))
    assert matrix.columns == ["prey", "X", "Y"] and [r.prey for r in matrix.collect()] == ["A", "B"]


def test_sketches_keep_their_rank(spark):
    """Merged over partitions, of any size: ranks are off by the error that k allows at most."""
    rng = np.random.default_rng(1)
    groups = {"a": rng.standard_normal(40_000), "b": np.floor(rng.exponential(5, 9_000)), "c": np.array([3.0])}
    table = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("none", None)], "g string, v double").repartition(7)
    at = {"low": 0.05, "mid": 0.5, "high": 0.95}
    for k in (200, 2000):
        for r in sketched(table, "v", at, ["g"], k).collect():
            v = np.sort(groups[r.g])
            for name, p in at.items():
                below, upto = np.searchsorted(v, r[name], "left") / len(v), np.searchsorted(v, r[name], "right") / len(v)
                assert below - rank_error(k) <= p <= upto + rank_error(k), (r.g, name, k)
    assert tuple(sketched(table.limit(0), "v", at).first()) == (None, None, None)
    plan = sketched(table, "v", at, ["g"])._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Generate" not in plan


def test_attribution_threshold_by_sketch(spark):
    rng = np.random.default_rng(2)
    scores = spark.createDataFrame([(i, t, rng.standard_normal(300).tolist()) for i in range(40) for t in (0, 1)], "region int, track int, scores array<double>")
    gaps = spark.createDataFrame([(i, 10 * k, 10 * k + 7) for i in range(40) for k in range(0, 28, 2)], "region int, gap_start_rel int, gap_end_rel int")
    exact = {r.track: r.threshold for r in coop.attribution_threshold(gaps, scores, 95.0).collect()}
    for r in coop.attribution_threshold(gaps, scores, 95.0, 4000).collect():
        assert abs(r.threshold - exact[r.track]) < 0.05
    assert quantiles(gaps, "gap_end_rel", {"m": 0.5}).first().m == pytest.approx(137.0)


def test_boosting_stops_on_noise_and_learns_a_rule(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(360):
        seq = "".join(rng.choice("ACGT") for _ in range(40))
        rows.append((seq, float(seq.count("GC")), float(seq.count("GC") > 2), rng.gauss(0, 1), float(rng.random() < 0.5), rng.choice(["train", "train", "val", "test"])))
    table = spark.createDataFrame(rows, "seq string, target_reg_log double, target_class double, noise double, coin double, split string")
    part = lambda name, noisy: table.where(F.col("split") == name).select("seq", *([F.col("noise").alias("target_reg_log"), F.col("coin").alias("target_class")] if noisy else ["target_reg_log", "target_class"]))
    noise = training.fit_two_heads(part("train", True), trees=15, val=part("val", True))
    assert all(model.stages[-1].getNumTrees < 15 for model, _ in noise)
    heads = training.fit_two_heads(part("train", False), trees=15, val=part("val", False))
    curve = training.learning_curve(heads, {"train": part("train", False), "val": part("val", False)})
    trees = {name: model.stages[-1].getNumTrees for model, name in heads}
    assert curve.count() == 2 * sum(trees.values())
    errors = {(r.head, r.stage, r.round): r.mse for r in curve.collect()}
    assert errors["reg", "train", trees["p_reg__"]] < errors["reg", "train", 1]
    assert errors["reg", "val", trees["p_reg__"]] <= min(e for (h, s, _), e in errors.items() if (h, s) == ("reg", "val")) * 1.01
    scored = part("test", False)
    for model, name in heads:
        scored = model.transform(scored).select("seq", "target_reg_log", "target_class", *[c for c in ("p_reg__", "p_class__") if c == name or c in scored.columns])
    named = scored.select(F.col("p_reg__").alias("p_reg"), F.col("target_reg_log").alias("y_reg"), (F.col("p_class__") - 0.5).alias("z_class"), F.col("target_class").alias("y_class"), F.lit("test").alias("split"))
    m = training.metrics(named, ["split"]).first()
    spread = scored.agg(F.var_pop("target_reg_log")).first()[0]
    assert m.mse < 0.75 * spread and m.accuracy > 0.68
    assert all(model.stages[-1].getNumTrees == 3 for model, _ in training.fit_two_heads(part("train", False), trees=3, val=part("val", False).limit(0)))
