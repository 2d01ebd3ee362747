"""Streams whose files hold motifs without sequences, against the batch result, and what their state and files hold."""

import pytest
from pyspark.sql import functions as F

from coopspark.operators import ablation
from coopspark.plans import pipeline_queries as queries
from coopspark.plans.adapters import sequenced, view
from coopspark.streaming import incremental

SCHEMA = "region bigint, tf string, start_rel bigint, end_rel bigint, pass_threshold_t0 int"


def text(df):
    return sorted(map(str, df.collect()))


def inputs(spark, source):
    rows = [(r, f"T{(i * 7 + (r or 0)) % 5}" if i % 11 else None, (i * 37 + (r or 0)) % 180 if i != 5 else None, (i * 37 + (r or 0)) % 180 + 6 + i % 3, i % 2 if i % 7 else None) for r in (*range(5), None) for i in range(24)]
    table = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        table.where(F.coalesce(F.col("start_rel"), F.lit(0)) % 3 == k).coalesce(1).write.mode("append").parquet(source)
    return table, spark.createDataFrame([(r, "ACGGCTAGC" * 25 + "GC" * r) for r in range(4)] + [(4, None)], "region bigint, seq string")


@pytest.mark.parametrize("python_model", [False, True])
def test_sequences_beside_the_files(spark, tmp_path, python_model):
    table, seqs = inputs(spark, str(tmp_path / "in"))
    model = ablation.PandasFnPredictor(queries.count_model) if python_model else ablation.default_predictor()
    want = ablation.pair_ablation(table, seqs, model, [0], 40)
    run = lambda: incremental.run_incremental_pairs(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), model, [0], 40, sequences=seqs, buckets=3)
    got = run()
    assert got.columns == want.columns and text(got) == text(want) and got.count() > 0
    assert text(run()) == text(want)
    single = incremental.run_incremental(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "single"), model, [0], 2, seqs)
    assert text(single) == text(ablation.single_ablation(table, seqs, model, [0], ablation.single_scores(table, seqs, model))) and single.count() > 0


def test_single_ablation_in_rows_of_masks(spark, monkeypatch, tmp_path):
    table, seqs = inputs(spark, str(tmp_path / "in"))
    model = ablation.default_predictor()
    want = text(ablation.single_ablation(table, seqs, model, [0, 1], ablation.single_scores(table, seqs, model)))
    monkeypatch.setattr(ablation, "ROW_MASKS", 5)
    got = ablation.single_ablation(table, seqs, model, [0, 1])
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") == 1  # with the sequences
    assert text(got) == want and got.dtypes[:5] == table.dtypes


def test_files_hold_no_sequences(spark, sf_dir, monkeypatch):
    """What the queries write for a stream are motifs; the sequence is made where it is scored."""
    seen = []
    monkeypatch.setattr(queries.incremental, "_run", lambda spark, source, schema, *rest: seen.append(spark.read.parquet(source)) or spark.createDataFrame([], "region bigint, tf1 string, tf2 string, start1 bigint, end1 bigint, start2 bigint, end2 bigint, isa_t0 double, interaction_t0 double"))
    for query in (queries.st1_incremental, queries.st1_incremental_pairs):
        query(spark, sf_dir)
    assert [sorted(df.columns) for df in seen] == [sorted(view(spark, sf_dir, "motifs").drop("score").columns)] * 2
    assert all(df.count() == view(spark, sf_dir, "motifs").count() for df in seen)
    assert sequenced(spark, sf_dir)(seen[0]).columns[-1] == "seq"
