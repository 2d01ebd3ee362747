"""Pairs scored in one pass, against masked texts and joins: regions of any number of motifs, odd texts and spans, and what the plan may not hold."""

import random

import pytest
from pyspark.sql import functions as F

from coopspark.operators import ablation, coop
from coopspark.plans import pipeline_queries as queries

CARRIED = "pass_threshold_t0"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def inputs(spark, many):
    rng = random.Random(many)
    texts = {1: "GCTA" * 40, 2: "".join(rng.choice("ACGTN") for _ in range(150)), 3: None, 4: "", 5: "äGC" * 9, 6: "GC"}
    rows = [(r, rng.choice(["A", "B", None]), s, s + rng.randint(-3, 9), rng.choice([0, 1, None])) for r in (*texts, 7) for s in (rng.randint(0, 170) for _ in range(many))]
    rows += rows[:3] + [(1, "A", None, 4, 1), (1, "A", 4, None, 1), (None, "A", 4, 5, 1), (2, "A", 1, 2**40, 1)]
    return spark.createDataFrame(rows, f"region bigint, tf string, start_rel bigint, end_rel bigint, {CARRIED} int"), spark.createDataFrame(list(texts.items()), "region bigint, seq string")


@pytest.mark.parametrize("many", [2, 9, 41])
def test_as_by_joins(spark, many):
    motifs, seqs = inputs(spark, many)
    if many == 9:
        motifs = motifs.unionByName(motifs.where("region = 2").withColumn("start_rel", -F.col("start_rel")))
    model = ablation.default_predictor()
    want = ablation.pair_ablation(motifs, seqs, model, [0, 1], 60, [CARRIED], ablation.original_scores(seqs, model))
    got = ablation.pair_ablation(motifs, seqs, model, [0, 1], 60, [CARRIED])
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
    flagged = motifs.withColumn("new", F.coalesce(F.col(CARRIED) == 1, F.lit(False)))
    for original in (None, ablation.original_scores(seqs, model)):
        some = ablation.pair_ablation(flagged, seqs, model, [0, 1], 60, [CARRIED], original, came="new")
        assert sorted(map(str, some.collect())) == sorted(map(str, got.where(f"tf1_{CARRIED} = 1 or tf2_{CARRIED} = 1").collect()))


def test_pairs_are_formed_and_scored_where_their_region_is(spark, sf_dir):
    """No join but those of the tables and sequences, nothing written before, no text shuffled, and the pairs' function runs once."""
    text = plan(queries._pairs(spark, sf_dir))
    assert "Window" not in text and text.count("SortMergeJoin") <= 2 and "lineitem" in text
    assert not any("seq" in line for line in text.splitlines() if "Exchange" in line)
    assert text.count("ArrowEvalPython") == 2  # one makes the sequences


def test_only_positive_pairs_are_shuffled(spark, sf_dir, monkeypatch):
    """Cooperativity reads the pairs as they are scored: no table of all pairs is written, and what isn't positive goes through no shuffle."""
    monkeypatch.setattr(ablation, "written", None)
    pairs = queries.rounded(queries._pairs(spark, sf_dir), "isa1_t0", "isa2_t0", "isa_both_t0", "interaction_t0", digits=9)
    lines = plan(coop.positive_interactions(coop.passing_pairs(pairs, 0), 0)).splitlines()
    moved = next(k for k, line in enumerate(lines) if "Exchange" in line)
    assert not any("Filter" in line for line in lines[:moved]) and "Filter" in "".join(lines[moved:])
    assert sum("ArrowEvalPython" in line for line in lines[moved:]) == 2
