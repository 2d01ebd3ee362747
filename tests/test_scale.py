"""What must hold so that the queries' cost follows their input: no broadcast of made texts, no interpreted lambda a letter, each sequence once."""

import os

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from coopspark import registry
from coopspark.functions import sequence
from coopspark.operators import ablation, sequences, training
from coopspark.plans.adapters import view
from coopspark.plans.scalar_queries import digits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_are_not_broadcast(spark, sf_dir):
    seqs = view(spark, sf_dir, "sequences")
    text = plan(view(spark, sf_dir, "motifs").drop("score").join(seqs, "region"))
    assert "SortMergeJoin [region" in text
    contigs = seqs.select(F.col("region").cast("string").alias("chrom"), "seq")
    asked = contigs.select("chrom", F.lit(3).cast("bigint").alias("start"), F.lit(300).cast("bigint").alias("end"))
    assert "BroadcastHashJoin" not in plan(sequences.sequences_of(asked, sequences.tiles(contigs, 128), 128))


def test_letters_of_words(spark):
    texts = [None, "", "G", "C", "GCG", "CGC", "ägcGCé", "", "GC"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1)
    got = df.select("i", ablation.letters_of("GC")(F.col("s")).alias("gc"), ablation.letters_of("C")(F.col("s")).alias("c")).orderBy("i").collect()
    assert [(r.gc, r.c) for r in got] == [(None if t is None else 2 * t.count("GC"), None if t is None else t.count("C")) for t in texts]


def test_one_hot_of_any_text_without_lambdas(spark):
    texts = [None, "", "ACGTN", "äAé\U0001f9ecT", "acgt"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").coalesce(1).select("i", sequence.one_hot(F.col("s")).alias("x"))
    got = [r.x for r in df.orderBy("i").collect()]
    assert got == [None if t is None else [[float(c == b) for c in t] for b in "ACGT"] for t in texts]
    shown = [r.d for r in df.select("i", digits(F.col("x")).alias("d")).orderBy("i").collect()]
    assert shown == [None if t is None else ["".join(str(int(c == b)) for c in t) for b in "ACGT"] for t in texts]
    assert "lambda" not in plan(df)


def test_both_strands_come_from_one_fetch(spark):
    genome = spark.createDataFrame([("c", 0, "ACGTT"), ("c", 1, "GGA")], "chrom string, tile bigint, seq string")
    table = spark.createDataFrame([("train", "c", 1, 7, 1.0, 1.0)], "split string, chrom string, start bigint, end bigint, target_reg double, target_class double")
    out = training.training_rows(table, genome, 5)
    assert sorted((r.is_rc, r.seq) for r in out.collect()) == [(False, "CGTTGG"), (True, "CCAACG")]
    assert "Union" not in plan(out)


@pytest.mark.parametrize("sizes", [{1: 50}, {1: 50, 2: 50}, {}])
def test_classes_of_few_names(spark, sf_dir, tmp_path, sizes):
    """With one TF the least and the greatest share are the same: all are in bin 0, in SQL too."""
    for t in os.listdir(sf_dir):
        if t != "part.parquet":
            os.symlink(f"{sf_dir}/{t}", tmp_path / t)
    cases = " ".join(f"WHEN p_brand = 'Brand#{b}' THEN {n}" for b, n in sizes.items())
    size = f"CASE {cases} ELSE 25 END" if sizes else "25"
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST({size} AS INT) AS p_size) FROM '{sf_dir}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = compare(spark, registry.queries()["r10_specificity_by_class"], registry.oracle_sql()["r10_specificity_by_class"], str(tmp_path))
    assert len(got) == len(sizes)


def test_masks_of_a_sequence_in_one_pass(spark, monkeypatch):
    """The model's own masking gives what masked texts give, also over several rows of masks and in pieces, and no text goes through a shuffle."""
    texts = {1: "GCGCAAAAGCTT", 2: "", 3: None, 4: "äGCTA", 5: "TACTAGC" * 9}
    seqs = spark.createDataFrame(list(texts.items()), "region bigint, seq string")
    spans = [(r, a, b, c, d) for r in (1, 2, 3, 4, 5, 6) for a, b, c, d in [(0, 1, None, None), (0, 1, 4, 99), (3, 2, None, None), (8, 9, 10, 11), (1, None, None, None)]]
    masks = spark.createDataFrame(spans + spans[:3], "region bigint, start1 bigint, end1 bigint, start2 bigint, end2 bigint")
    model = ablation.default_predictor()
    want = ablation.mask_scores(masks, seqs, model, ablation.original_scores(seqs, model)).collect()
    monkeypatch.setattr(ablation, "ROW_MASKS", 2)
    assert sorted(map(str, want)) == sorted(map(str, ablation.mask_scores(masks, seqs, model).collect())) and len(want) == 25
    made = lambda df: df.join(seqs.select("region"), "region").withColumn("seq", F.lit("GCTA"))
    assert "seq" not in "".join(line for line in plan(ablation.mask_scores(masks, made, model)).splitlines() if "Exchange" in line)


def test_translated_and_masked_by_batch(spark):
    texts = [None, "", "0c8", "ä0b", "5" * 30]
    df = spark.createDataFrame([(t, a, b) for t in texts for a, b in [(0, 0), (2, 9), (3, 1), (-2, 1), (None, 1), (1, None)]], "s string, a bigint, b bigint").coalesce(1)
    got = df.select(sequence.translated(F.col("s"), "08bc", "ACGT").alias("t"), F.translate("s", "08bc", "ACGT").alias("u"), sequence.masked_by_batch(F.col("s"), (F.col("a"), F.col("b"))).alias("m"), sequence.masked(F.col("s"), F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.t == r.u and r.m == r.n for r in got)


def test_regions_in_one_tile_are_not_gathered(spark):
    """A region inside one tile meets it in one join; others, and such without a tile, come out as before; a genome may be made of keys."""
    tiles = spark.createDataFrame([("c", 0, "acgtt"), ("c", 1, "GGA")], "chrom string, tile bigint, seq string")
    rows = [("c", 0, 5, "ACGTT"), ("c", 5, 8, "GGA"), ("c", 5, 9, None), ("c", 3, 3, None), ("d", 0, 4, None), ("c", -1, 3, None), ("c", 1, 3, "CG"), ("c", 1, 3, "CG")]
    regions = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, want string")
    made = lambda df: df.join(tiles.select("chrom", "tile").withColumn("known", F.lit(True)), ["chrom", "tile"], "left").withColumn("seq", F.expr("CASE WHEN known THEN elt(tile + 1, 'ACGTT', 'GGA') END"))
    for genome in (tiles, made):
        got = sequences.sequences_of(regions, genome, 5)
        assert got.count() == len(rows) and got.where("NOT seq <=> want").count() == 0
        long = sequences.sequences_of(regions.unionByName(spark.createDataFrame([("c", 3, 7, "TTGG")], regions.schema)), genome, 5)
        assert long.count() == len(rows) + 1 and long.where("NOT seq <=> want").count() == 0
        assert sequences.sequences_of(regions.limit(0), genome, 5).count() == 0
    one = training.training_rows(regions.where("want is not null").selectExpr("'train' AS split", "chrom", "start", "end", "1.0D AS target_reg", "1.0D AS target_class"), tiles, 5)
    assert "collect_list" not in plan(one) and one.count() == 8


def test_labels_are_measured_once(spark, sf_dir):
    """Counts, samples and rows read a written table of labels, not the joins that measure it."""
    text = plan(registry.queries()["c1_compile_topped_up"](spark, sf_dir))
    assert "value_r" not in text and "collect_list" not in text


def test_fasta_lines_are_not_shuffled(spark, sf_dir):
    """A file's lines go to Python and out as tiles; shuffled are only pieces at the borders of ranges."""
    text = plan(registry.queries()["s5_fasta_tiles"](spark, sf_dir))
    shuffles = [line for line in text.splitlines() if "Exchange hash" in line or "Window" in line]
    assert len(shuffles) == 1 and "of#" in shuffles[0]


def test_pairs_move_once_to_their_scores(spark):
    """Pairs and scores are by region: no join by region and spans shuffles them again, and the session keeps its setting."""
    from coopspark.plans.stage import fewer_keys

    pairs = spark.createDataFrame([(1, 0, 5, 9, 12)], "region bigint, start1 bigint, end1 bigint, start2 bigint, end2 bigint")
    single = spark.createDataFrame([(1, 0, 5, [1.0]), (1, 9, 12, [2.0])], "region bigint, start_rel bigint, end_rel bigint, isa array<double>")
    both = pairs.withColumn("isa", F.array(F.lit(4.0)))
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    small_ = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with fewer_keys(spark):
            out = ablation._assembled(pairs, single, both, [0])
            moved = [line.split("Exchange ")[1] for line in plan(out).splitlines() if "Exchange " in line]
            assert [tuple(r) for r in out.collect()] == [(1, 0, 5, 9, 12, 1.0, 2.0, 4.0, -1.0)]
        assert len(moved) == 4 and all("REPARTITION_BY" in m for m in moved), moved  # no join asks for one; the single scores are read by two
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small_)
    assert spark.conf.get(name) == before


def test_pieces_of_regions_are_not_shuffled(spark, sf_dir):
    """Keys are shuffled, not tiles or pieces: a tile's letters are made where its region is, and the pieces stay there; rows alike come out as often as they went in."""
    out = registry.queries()["p2_sequences"](spark, sf_dir)
    text = plan(out)
    moved = [line for line in text.splitlines() if "Exchange" in line]
    assert moved and not any("part" in line.split("hashpartitioning")[-1].split(")")[0] for line in moved)
    assert len(moved) <= 6 and text.count("Join") == 2  # regions inside one tile, and longer ones, with the keys
    assert "translate" not in "".join(text[text.index("Exchange") :].splitlines()[1:2])
    tiles = spark.createDataFrame([("c", 0, "acgtt"), ("c", 1, "GGA")], "chrom string, tile bigint, seq string")
    rows = [("c", 3, 7, None, "TTGG")] * 3 + [("c", 3, 7, 1.0, "TTGG"), ("c", 4, 9, 1.0, None), ("d", 4, 9, None, None), (None, 1, 9, 2.0, None), ("c", None, 9, 2.0, None), ("c", 9, 2, 2.0, None)]
    got = sequences.sequences_of(spark.createDataFrame(rows, "chrom string, start bigint, end bigint, more double, want string"), tiles, 5)
    assert got.count() == len(rows) and got.where("NOT seq <=> want").count() == 0
