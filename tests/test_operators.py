"""Value tests of operators and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coopspark.functions import scalars, sequence
from coopspark.operators.quantiles import quantiles
from coopspark.operators import ablation, annotate, components, coop, intervals, rankstats, report, running, sequences, training
from coopspark.plans.quickstart import QuickStart
from coopspark.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_one_hot_and_reverse(spark):
    assert one(spark, sequence.one_hot(F.lit("ACGTN"))) == [[1, 0, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0]]
    assert one(spark, sequence.one_hot(F.lit("NNNN"))) == [[0] * 4] * 4
    assert one(spark, sequence.reverse_complement(F.lit("AACGN"))) == "NCGTT"


def test_masks(spark):
    assert one(spark, sequence.masked(F.lit("ATGCATGC"), F.lit(2), F.lit(3))) == "ATNNATGC"
    assert one(spark, sequence.masked(F.lit("ATGC"), F.lit(3), F.lit(9))) == "ATGN"
    spans = lambda *s: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s])
    assert one(spark, sequence.masked_spans(F.lit("ATGCATGC"), spans((5, 6), (0, 1)))) == "NNGCANNC"
    assert one(spark, sequence.masked_spans(F.lit("ATGCATGC"), spans((0, 2), (2, 4)), "null")) is None
    with pytest.raises(Exception, match="overlapping"):
        one(spark, sequence.masked_spans(F.lit("ATGCATGC"), spans((0, 2), (2, 4))))


@pytest.mark.parametrize(("name", "prefix"), [("SOX2", "SOX"), ("ESRRA", "ESRRA"), ("GATA1", "GATA"), ("123", "123")])
def test_prefix(spark, name, prefix):
    assert one(spark, scalars.name_prefix(F.lit(name))) == prefix


def test_scalars(spark):
    assert one(spark, F.array(*[scalars.binding_flag(F.lit(x)) for x in (" 0 ", "0.0", None, "1")])) == [0, 1, 1, 1]
    assert one(spark, scalars.minus_log10(F.lit(0.0))) == pytest.approx(300)
    assert one(spark, scalars.signed_cbrt(F.lit(-8.0))) == pytest.approx(-2)
    assert one(spark, scalars.signed_cube(F.lit(-2.0))) == pytest.approx(-8)
    assert one(spark, F.array(*[scalars.category_order(F.lit(c)) for c in ("Independent", "Synergistic", "x")])) == [0, 3, None]
    assert one(spark, scalars.expressed(F.lit("a::b::c"), F.array(F.lit("A"), F.lit("C")))) is False


def test_run_compression(spark):
    names = ["SOX2", "SOX9", "GATA1", "SOX4", "KLF4", "KLF5"]
    out = report.compressed_labels(spark.createDataFrame(list(enumerate(names)), "i int, n string"), "n", "i").orderBy("i").collect()
    assert [r.label for r in out] == ["SOXs", "", "GATA1", "SOX4", "KLFs", ""]


def test_readers(spark, tmp_path):
    (tmp_path / "names").write_text("# comment\n\nGATA1\n SOX2 \n")
    assert {r.name for r in readers.read_names(spark, str(tmp_path / "names")).collect()} == {"GATA1", "SOX2"}
    (tmp_path / "pfm").write_text(">MA1\tm1\nA [ 1 1 ]\nC [ 1 0 ]\nG [ 0 1 ]\nT [ 0 0 ]\n>MA2\tm2\nA [ 3 ]\nC [ 0 ]\nG [ 1 ]\nT [ 0 ]\n")
    assert {r.tf: r.gc for r in readers.gc_fraction(readers.read_pfms(spark, str(tmp_path / "pfm"))).collect()} == {"M1": 0.5, "M2": 0.25}
    (tmp_path / "fa").write_text(">chr1 x\n" + "A" * 7 + "\n" + "c" * 6 + "\n>chr2\nGG\n")
    tiles = readers.read_fasta(spark, str(tmp_path / "fa"), 5)
    assert {(r.chrom, r.tile): r.seq for r in tiles.collect()} == {("chr1", 0): "AAAAA", ("chr1", 1): "AAccc", ("chr1", 2): "ccc", ("chr2", 0): "GG"}
    asked = spark.createDataFrame([("chr1", 3, 12), ("chr1", 10, 14), ("chr2", 0, 2), ("chr3", 0, 2), ("chr1", -1, 3)], "chrom string, start bigint, end bigint")
    assert {(r.chrom, r.start): r.seq for r in sequences.sequences_of(asked, tiles, 5).collect()} == {("chr1", 3): "AAAACCCCC", ("chr1", 10): None, ("chr2", 0): "GG", ("chr3", 0): None, ("chr1", -1): None}


def ranks_by_hand(group, null):
    values = np.unique(np.concatenate([group, null]))
    d = max(abs((group <= v).mean() - (null <= v).mean()) for v in values)
    u = sum((null < x).sum() + 0.5 * (null == x).sum() for x in group)
    _, ties = np.unique(np.concatenate([group, null]), return_counts=True)
    return d, u, float((ties.astype(float) ** 3 - ties).sum())


def test_rank_pass_by_hand(spark):
    rng = np.random.default_rng(5)
    null = rng.integers(0, 30, 200).astype(float)
    groups = {f"g{k}": rng.integers(k, 30 + k, 5 + 11 * k).astype(float) for k in range(6)}
    rows = [(n, float(v)) for n, vs in groups.items() for v in vs] + [("g1", None)]
    out = rankstats.rank_pass(spark.createDataFrame(rows, "name string, value double"), spark.createDataFrame([(float(v),) for v in null], "value double"))
    for r in out.collect():
        d, u, ties = ranks_by_hand(groups[r.name], null)
        assert (r.n, r.n0) == (len(groups[r.name]), 200)
        assert r.ks_d == pytest.approx(d) and r.mw_u == pytest.approx(u) and r.tie_sum == pytest.approx(ties)
    empty = spark.createDataFrame([], "value double")
    assert rankstats.rank_pass(spark.createDataFrame(rows, "name string, value double"), empty).count() == 0


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    rows = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(p)], "name string, p double")
    q = {r.name: r.q for r in rankstats.benjamini_hochberg(rows, "p", "q", "name").collect()}
    assert [q[f"t{i}"] for i in range(5)] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.9])


def test_cooperativity_empty(spark):
    cols = "region string, tf1 string, tf2 string, distance int, tf1_pass_threshold_t0 int, tf2_pass_threshold_t0 int, isa1_t0 double, isa2_t0 double, isa_both_t0 double, interaction_t0 double"
    assert coop.cooperativity(spark.createDataFrame([], cols), "tf", 0, 10).count() == 0
    near = spark.createDataFrame([("r", "a", "b", 5, 1, 1, 1.0, 1.0, 1.5, 0.5)], cols)
    assert coop.cooperativity(near, "tf_pair", 100, 200).count() == 0


def test_cooperativity_counts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        a, b = rng.choice([("A", "B"), ("B", "A"), ("C", "C"), ("A", "C")])
        x = rng.uniform(-1, 1) + (0.8 if {a, b} == {"A", "B"} else 0)
        rows.append((f"r{i}", a, b, rng.randrange(1, 200), 1, int(i % 10 > 0), 2.0, 2.0, 4.0 - x, x))
    cols = "region string, tf1 string, tf2 string, distance int, tf1_pass_threshold_t0 int, tf2_pass_threshold_t0 int, isa1_t0 double, isa2_t0 double, isa_both_t0 double, interaction_t0 double"
    table = spark.createDataFrame(rows + rows[:5], cols)
    kept = [r for r in rows if r[5] and r[8] > 2]
    pair = {r.tf_pair: r for r in coop.cooperativity(table, "tf_pair", 100, 200).collect()}
    assert set(pair) == {"A|B", "C|C", "A|C"}
    for name, r in pair.items():
        own = [k[9] for k in kept if "|".join(sorted(k[1:3])) == name]
        assert r["count"] == len(own) and r.coop_score == pytest.approx(sum(own) / sum(map(abs, own)), abs=1e-4)
        d, u, _ = ranks_by_hand(np.array(own), np.array([k[9] for k in kept if 100 < k[3] <= 200]))
        assert r.ks_d == pytest.approx(d, abs=1e-6) and r.mw_d == pytest.approx(u)
    single = {r.tf: r["count"] for r in coop.cooperativity(table, "tf", 100, 200).collect()}
    assert single["C"] == sum((k[1] == "C") + (k[2] == "C") for k in kept)


def test_signed_ks(spark):
    rows = [("low", float(v)) for v in range(10)] + [("high", float(v)) for v in range(20, 30)] + [("few", 1.0)]
    out = {r.g: r.ks for r in rankstats.signed_ks(spark.createDataFrame(rows, "g string, v double"), "g", "v", 5).collect()}
    assert out["low"] < 0 < out["high"] and out["few"] is None


def test_ablation_small(spark):
    seqs = spark.createDataFrame([("r", "GCGCAAAAGCTT"), ("lonely", "GCAA")], "region string, seq string")
    motifs = spark.createDataFrame([("r", "A", 0, 1, 1), ("r", "B", 2, 3, 1), ("r", "C", 2, 5, 1), ("lonely", "A", 0, 1, 1)], "region string, tf string, start_rel bigint, end_rel bigint, pass_threshold_t0 int")
    model = ablation.ExprPredictor(lambda s: F.length(s) - F.length(F.replace(s, F.lit("GC"), F.lit(""))))
    single = {(r.region, r.tf): r.isa_t0 for r in ablation.single_ablation(motifs, seqs, model, [0]).collect()}
    assert single == {("r", "A"): 2, ("r", "B"): 2, ("r", "C"): 2, ("lonely", "A"): 2}
    pairs = {(r.tf1, r.tf2): (r.distance, r.interaction_t0) for r in ablation.pair_ablation(motifs, seqs, model, [0], 10).collect()}
    assert pairs == {("A", "B"): (2, 0), ("A", "C"): (2, 0)}
    assert ablation.pair_ablation(motifs, seqs, model, [0], 1).count() == 0
    assert ablation.single_ablation(motifs.limit(0), seqs, model, [0]).count() == 0


def test_masks_are_scored_once(spark, sf_dir, tmp_path):
    """Sequences that a Python model sees: originals, distinct single masks and distinct pairs, each once, in a batch and in a stream."""
    from coopspark.plans.adapters import view
    from coopspark.streaming import incremental

    seen = spark.sparkContext.accumulator(0)

    def load():
        def predict(seqs):
            seen.add(len(seqs))
            return np.array([[float(s.count("N"))] for s in seqs])

        return predict

    model = ablation.PandasFnPredictor(load)
    motifs = view(spark, sf_dir, "motifs").where("region < 2000").drop("score", "pass_threshold_t1")
    sequences = view(spark, sf_dir, "sequences").where("region < 2000")
    pairs = ablation.motif_pairs(motifs, 100, ["pass_threshold_t0"])
    want = sequences.count() + motifs.select("region", "start_rel", "end_rel").distinct().count() + pairs.select("region", "start1", "end1", "start2", "end2").distinct().count()
    rows = ablation.pair_ablation(motifs, sequences, model, [0], 100).collect()
    assert seen.value == want and len(rows) == pairs.count() > 0

    motifs.join(sequences, "region").repartition(2, "region").write.parquet(str(tmp_path / "in"))
    schema = "region bigint, tf string, start_rel bigint, end_rel bigint, pass_threshold_t0 int, seq string"
    seen.value = 0
    first = incremental.run_incremental(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), model, [0])
    assert first.count() == motifs.join(sequences, "region").count()
    regions = motifs.join(sequences, "region").select("region").distinct().count()
    assert seen.value == regions + motifs.join(sequences, "region").select("region", "start_rel", "end_rel").distinct().count()
    seen.value = 0
    assert incremental.run_incremental(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), model, [0]).count() == first.count()
    assert seen.value == 0


def test_attribution(spark):
    scores = spark.createDataFrame([("r", 0, [1.0, 5.0, 2.0, 9.0, 3.0]), ("r", 1, [0.0] * 5)], "region string, track int, scores array<double>")
    motifs = spark.createDataFrame([("r", "A", 0, 3), ("r", "B", 3, 4), ("r", "C", 2, 9)], "region string, tf string, start_rel int, end_rel int")
    limits = spark.createDataFrame([(0, 1.5), (1, 0.5)], "track int, threshold double")
    out = {r.tf: (r.second_max_t0, r.pass_threshold_t0, r.pass_threshold_t1) for r in coop.attribution_filter(motifs, scores, limits, [0, 1]).collect()}
    assert out == {"A": (2.0, 1, 0), "C": (3.0, 1, 0)}


def test_families_and_cofactors(spark):
    fam = spark.createDataFrame([("Gata1", "zf"), ("SOX2", "hmg"), ("SOX9", "hmg"), ("X1", "Not in JASPAR"), ("X2", "Not in JASPAR")], "symbol string, family string")
    pairs = spark.createDataFrame([("gata1|SOX2",), ("SOX2|sox9",), ("X1|X2",), ("nope|SOX2",)], "tf_pair string")
    once = annotate.annotate_family(pairs, fam)
    out = {r.tf_pair: (r.family1, r.same_family) for r in annotate.annotate_family(once, fam).collect()}
    assert out == {"gata1|SOX2": ("zf", False), "SOX2|sox9": ("hmg", True), "X1|X2": ("Not in JASPAR", False), "nope|SOX2": (None, False)}
    assert annotate.annotate_family(spark.createDataFrame([("gata1",)], "tf string"), fam, None).first().family == "zf"
    matrix = spark.createDataFrame([("A", 1), ("B", 0)], "TF string, p300 int")
    counted = annotate.recruiters(spark.createDataFrame([("A|A",), ("A|B",), ("B|C",)], "tf_pair string"), matrix, ["p300"])
    assert {r.tf_pair: r.count_p300 for r in counted.collect()} == {"A|A": 2, "A|B": 1, "B|C": 0}


def test_dimers_as_the_product_of_names(spark):
    names = ["A", "B", "C::D", "", None]
    keys = ["A", "A::B", "B::A", "A::A", "A::C::D", "C::D", "C::D::C::D", "A::X", "A:::B", "::", "A::", "X", "", None, "A::B::A"]
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys + keys)], "tf string, i int")
    real = [n for n in names if n is not None]
    want = {*real, *(f"{a}::{b}" for a in real for b in real)}
    got = annotate.is_listed(table, spark.createDataFrame([(n,) for n in names + names], "name string"), "tf")
    assert sorted((r.tf, r.i) for r in got.collect()) == sorted((k, i) for i, k in enumerate(keys + keys) if k in want)
    assert got.columns == ["tf", "i"]
    assert annotate.is_listed(table.where("i < 0"), spark.createDataFrame([("A",)], "name string"), "tf").count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(1, 1)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: top(n) for a, b in edges if a != b for n in (a, b)}


def test_running_sum(spark):
    rows = [(random.Random(i).choice(["a", None, "b"]), i % 7, i) for i in range(200)]
    out = running.running_sum(spark.createDataFrame(rows, "g string, o int, v int"), "v", ["o"], ["g"]).collect()
    for r in out:
        assert r.running == sum(v for g, o, v in rows if g == r.g and o <= r.o)
    assert running.running_sum(spark.createDataFrame([], "g string, o int, v int"), "v", ["o"]).count() == 0


def test_rolling_and_density(spark):
    rows = spark.createDataFrame([(i, float(i * i % 7)) for i in range(9)], "i int, v double")
    area = report.density(rows.select((F.col("v") / 20).alias("v")), "v", 200).agg(F.sum("density")).first()[0] * 2 / 199
    assert area == pytest.approx(1, abs=0.05)


def test_balance(spark):
    cols = "chrom string, start bigint, end bigint, target_class double"
    pos = spark.createDataFrame([("chr1", i, i + 10, 1.0) for i in range(6)], cols)
    neg = spark.createDataFrame([("chr1", i, i + 10, 0.0) for i in range(100, 102)], cols)
    pool = spark.createDataFrame([("chr3", i, i + 30) for i in range(50)], "chrom string, start bigint, end bigint")
    up = training.balanced(pos, neg, pool, 10)
    assert {r.target_class: r["count"] for r in up.groupBy("target_class").count().collect()} == {1.0: 6, 0.0: 6}
    assert up.where("end - start <> 10").count() == 0
    assert training.balanced(neg, pos, pool, 10).groupBy("target_class").count().where("count = 2").count() == 2


def test_quickstart(spark):
    rng = random.Random(4)
    contigs = spark.createDataFrame([(f"chr{k}", "".join(rng.choice("ACGT") for _ in range(30_000))) for k in (1, 2)], "chrom string, seq string")
    genome = sequences.tiles(contigs, 1000)
    regions = spark.createDataFrame([(f"chr{1 + i % 2}", 500 + 700 * i, 900 + 700 * i) for i in range(40)], "chrom string, start bigint, end bigint")
    signal = spark.createDataFrame([(f"chr{1 + i % 2}", 650 + 700 * i, 700 + 700 * i, 2.0, "t") for i in range(0, 40, 3)], "chrom string, start bigint, end bigint, value double, track string")
    q = QuickStart(spark, genome, 1000, seq_len=200, dist_min=20, dist_max=100, min_count=5)
    with pytest.raises(ValueError, match="nothing to train"):  # all signal is alike, so none is above its 99th percentile
        q.train(regions, signal, regions)
    _, metrics = q.train(regions, signal, regions, threshold=0.0)
    assert metrics.count() == 1 and q.curve.count() > 0
    q.predictor = ablation.default_predictor()
    hits = spark.createDataFrame([(f"chr{1 + i % 2}", 500 + 700 * i + o, 510 + 700 * i + o, rng.choice(["a", "b", "A::b"]), 900, "+") for i in range(40) for o in range(0, 380, 25)], "chrom string, start bigint, end bigint, tf string, score bigint, strand string")
    names = spark.createDataFrame([("A",), ("b",)], "name string")
    tables = q.run_isa(regions, hits, percentile=30.0, expressed=names)
    assert tables["motifs"].count() > 0 and tables["pairs"].count() > 0 and tables["importance"].count() == 3
    reports = q.report(tables)
    assert {"null", "decay", "histogram", "heatmap", "distance", "specificity"} <= set(reports)
    assert reports["decay"].count() > 0
    assert q.report({}) == {}


def test_quantiles_as_percentile(spark):
    rows = [("hot" if i % 3 else None, float(i % 7) if i % 5 else None) for i in range(300)] + [("one", -1.5), ("none", None), ("two", 1.0), ("two", 2.0), ("far", float("inf")), ("far", 0.0), ("far", float("inf"))]
    table = spark.createDataFrame(rows, "g string, v double")
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r.g: tuple(r)[1:] for r in quantiles(table, "v", at, ["g"]).collect()}
    plain = table.where("v is not null").groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in at.items()])
    assert got == {r.g: pytest.approx(tuple(r)[1:]) for r in plain.collect()}
    whole = table.agg(*[F.percentile("v", p).alias(n) for n, p in at.items()]).first()
    assert tuple(quantiles(table, "v", at).first()) == pytest.approx(tuple(whole))
    assert tuple(quantiles(table.limit(0), "v", at).first()) == (None,) * 5
    assert quantiles(table.limit(0), "v", at, ["g"]).count() == 0


def test_classes_at_their_limits(spark):
    """Scores equal to a quantile are between the classes; rows without a significant q are independent."""
    table = spark.createDataFrame([(f"p{i}", i / 10, 0.01) for i in range(11)] + [("weak", 5.0, 0.5), ("none", 5.0, None)], "name string, coop_score double, ks_q double")
    got = {r.name: r.cooperativity for r in coop.assign_classes(table).collect()}
    assert [got[f"p{i}"] for i in range(11)] == ["Redundant"] * 3 + ["Intermediate"] * 5 + ["Synergistic"] * 3
    assert got["weak"] == got["none"] == "Independent"
