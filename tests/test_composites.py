"""Composite calls: expressed names, training data, stages that resume, and all report tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coopspark.operators import ablation, report, sequences, training
from coopspark.plans.ledger import Ledger, content_digest
from coopspark.plans.quickstart import QuickStart

PLACES = "chrom string, start bigint, end bigint"


def test_expressed_names(spark):
    """Names above the noise of the background, strictly; each once, in order."""
    promoters = spark.createDataFrame([("c", 1000, 2000, "GATA1"), ("c", 3000, 4000, "SOX2"), ("c", 5000, 6000, "TAL1"), ("c", 7000, 8000, "NANOG"), ("c", 1000, 2000, "GATA1")], PLACES + ", name string")
    height = {1000: 12.0, 3000: 1.0, 5000: 5.0, 7000: 50.0, 20_000: 5.0}
    signal = spark.createDataFrame([("c", at + 499, at + 500, v, "t") for at, v in height.items()], PLACES + ", value double, track string")
    background = spark.createDataFrame([("c", 20_000, 21_000)] * 3, PLACES)
    assert [r.name for r in training.get_expressed_tfs(promoters, background, signal, 600).collect()] == ["GATA1", "NANOG"]
    assert training.get_expressed_tfs(promoters, background, signal.withColumn("value", F.when(F.col("start") > 20_000, 100.0).otherwise(F.col("value"))), 600).count() == 0
    assert training.get_expressed_tfs(promoters, background.limit(0), signal, 600).count() == 0


def test_label_modes(spark):
    regions = spark.createDataFrame([("c", 1000 * i, 1000 * i + 10, float(i % 3), i % 2) for i in range(12)], PLACES + ", own double, kind int")
    genome = sequences.tiles(spark.createDataFrame([("c", "ACGT" * 4000)], "chrom string, seq string"), 1000)
    pool = spark.createDataFrame([("c", 1000 * i + 400, 1000 * i + 420) for i in range(14)], PLACES)
    counts = lambda **more: {r.target_class: r["count"] for r in training.compile_training_data(regions, genome, more.pop("signal", None), pool, 10, 1000, **more).where("not is_rc").groupBy("target_class").count().collect()}
    assert counts(target_col="own") == {1.0: 8, 0.0: 8}
    assert counts(target_col="own", class_col="kind") == {1.0: 6, 0.0: 6}
    signal = spark.createDataFrame([("c", 1000 * i, 1000 * i + 10, float(i % 3), "t") for i in range(12)] + [("c", 1000 * i + 405, 1000 * i + 415, 1.5, "t") for i in range(14)], PLACES + ", value double, track string")
    # The background's signal is 15: of 0, 10 and 20 only the last is above.
    assert counts(signal=signal) == {1.0: 4, 0.0: 4}
    assert counts(signal=signal, threshold=5.0) == {1.0: 8, 0.0: 8}
    with pytest.raises(ValueError, match="signal"):
        counts()


def inputs(spark):
    rng = random.Random(4)
    contigs = spark.createDataFrame([(f"chr{k}", "".join(rng.choice("ACGT") for _ in range(12_000))) for k in (1, 2)], "chrom string, seq string")
    regions = spark.createDataFrame([(f"chr{1 + i % 2}", 500 + 700 * i, 900 + 700 * i) for i in range(16)], PLACES)
    hits = spark.createDataFrame([(f"chr{1 + i % 2}", 500 + 700 * i + o, 510 + 700 * i + o, rng.choice(["A", "B", "A::B"]), 900, "+") for i in range(16) for o in range(0, 380, 25)], PLACES + ", tf string, score bigint, strand string")
    return sequences.tiles(contigs, 1000), regions, hits


def test_a_run_goes_on_after_its_last_stage(spark, tmp_path, monkeypatch):
    from coopspark.operators import coop

    genome, regions, hits = inputs(spark)
    seen = spark.sparkContext.accumulator(0)

    def load():
        def predict(seqs):
            seen.add(len(seqs))
            return np.array([[float(s.count("GC"))] for s in seqs])

        return predict

    q = QuickStart(spark, genome, 1000, predictor=ablation.PandasFnPredictor(load), dist_min=20, dist_max=100, min_count=5)
    path = str(tmp_path / "run")
    real = coop.tf_importance
    monkeypatch.setattr(coop, "tf_importance", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        q.run_isa(regions, hits, 30.0, path=path)
    first = seen.value
    monkeypatch.setattr(coop, "tf_importance", real)
    out = q.run_isa(regions.orderBy(F.desc("start")), hits, 30.0, path=path)
    assert first > 0 and seen.value == first
    assert out["pairs"].count() > 0 and out["importance"].count() == 3 and set(out) == {"motifs", "single", "pairs", "importance", "coop_tf_pair_t0", "coop_tf_t0"}
    # A torn stage (no marker) and one with other parameters are written anew, and what follows them.
    Ledger(spark, path)._file(f"{path}/_ledger/single.json")[0].delete(Ledger(spark, path)._file(f"{path}/_ledger/single.json")[1], False)
    q.run_isa(regions, hits, 30.0, path=path)
    assert seen.value == first  # its masks are still there
    q.model_version = "2"
    q.run_isa(regions, hits, 30.0, path=path)
    assert seen.value == 2 * first
    assert content_digest(regions) == content_digest(regions.repartition(5)) != content_digest(regions.limit(15))


def tables(spark):
    rng = random.Random(7)
    names = ["GATA1", "GATA2", "SOX2", "SOX9", "KLF4", "A::B"]
    kinds = ["Independent", "Redundant", "Intermediate", "Synergistic"]
    pairs = [(f"{a}|{b}", rng.uniform(-1, 1) if (a, b) != ("GATA1", "KLF4") else None, rng.uniform(0, 1), rng.uniform(50, 150), rng.random(), rng.choice(kinds), 12) for i, a in enumerate(names) for b in names[i:]]
    tfs = [(n, rng.uniform(-1, 1), rng.choice(kinds[1:]), 20) for n in names]
    by_pair = spark.createDataFrame(pairs, "tf_pair string, coop_score double, abs_i_sum double, mean_distance double, ks_p double, cooperativity string, count bigint")
    return by_pair, spark.createDataFrame(tfs, "tf string, coop_score double, cooperativity string, count bigint"), names


def test_every_report_table(spark):
    by_pair, by_tf, names = tables(spark)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    refs = {
        "gc": frame([(n, 0.1 * i) for i, n in enumerate(names)] + [("SOX2", 0.9)], "tf string, gc double"),
        "domains": frame([(n, n[:3]) for n in names[:5]], "symbol string, family string"),
        "dispersion": frame([(n, 0.2 * i if i else None) for i, n in enumerate(names)], "symbol string, gini double"),
        "cofactors": frame([("GATA1", 1, 0), ("SOX2", 1, 0), ("KLF4", 0, 0)], "TF string, p300 int, none int"),
        "binding": frame([("GATA1|SOX2", 1), ("GATA1|GATA2", 0), ("SOX2|SOX9", 1)], "tf_pair string, binds int"),
    }
    lists = {"universal": frame([("KLF4",), ("A",), ("B",)], "name string"), "pioneers": frame([("GATA1",), ("SOX2",)], "name string"), "nobody": frame([("X",)], "name string")}
    families = refs["domains"]
    q = QuickStart(spark, spark.createDataFrame([], "chrom string, tile bigint, seq string"), 1000)
    out = q.report({"coop_tf_pair_t0": by_pair, "coop_tf_t0": by_tf}, families=families, known=frame([("SOX2", "GATA1")], "TF1 string, TF2 string"), references=refs, lists=lists)
    assert {"motif_gc", "same_family", "same_family_test", "coop_by_family", "intra_family", "listed", "cell_specificity", "cofactor_recruitment", "dna_mediated", "specificity_by_class", "enrichment"} <= set(out)
    scores = {r.tf_pair: r.coop_score for r in by_pair.collect()}
    own = {r.tf: r for r in by_tf.collect()}
    # Motif GC: SOX2 counts with both motifs.
    assert sum(r.n for r in out["motif_gc"].collect()) == 7
    same = [v for p, v in scores.items() if v is not None and "::" not in p and p.split("|")[0][:3] == p.split("|")[1][:3]]
    test = out["same_family_test"].first()
    assert test.n == len(same) == 7 and test.n0 == len([v for v in scores.values() if v is not None]) - 7
    assert test.mw_method == "exact" and {r.same_family for r in out["same_family"].select("same_family").distinct().collect()} == {True, False}
    got = {r.family: r for r in out["coop_by_family"].collect()}
    assert set(got) == {"GAT", "SOX", "KLF"} and got["GAT"].median == pytest.approx(np.median([own["GATA1"].coop_score, own["GATA2"].coop_score]))
    assert out["intra_family"].count() == 0
    assert {r.family1: r.n for r in report.intra_family(by_pair, families, 3).collect()} == {"GAT": 3, "SOX": 3}
    listed = out["listed"].collect()
    assert {(r.kind, round(r.ecdf, 3)) for r in listed} == {("universal", 0.5), ("universal", 1.0), ("pioneers", 0.5), ("pioneers", 1.0)}
    assert out["cell_specificity"].count() == 5
    recruited = {(r.cofactor, r.recruiters): r.n for r in out["cofactor_recruitment"].collect()}
    kept = [p.split("|") for p, v in scores.items() if v is not None and "::" not in p]
    want = [sum(x in ("GATA1", "SOX2") for x in p) for p in kept]
    assert recruited == {("p300", k): want.count(k) for k in set(want)}
    mediated = {(r.measure, r.binds): r.n for r in out["dna_mediated"].collect()}
    assert mediated == {("coop_score", 1): 2, ("coop_score", 0): 1, ("minus_log10_ks_p", 1): 2, ("minus_log10_ks_p", 0): 1}
    assert "::" not in "".join(r.tf_pair for r in out["enrichment"].collect())
