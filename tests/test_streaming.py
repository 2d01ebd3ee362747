"""Pairs of regions that come in pieces, against the batch result."""

import pytest
from pyspark.sql import functions as F

from coopspark.operators import ablation
from coopspark.streaming import incremental

SCHEMA = "region bigint, tf string, start_rel bigint, end_rel bigint, pass_threshold_t0 int, seq string"


def text(df):
    return sorted(map(str, df.collect()))


def test_a_region_in_three_files(spark, tmp_path):
    rows = [(r, f"T{(i * 7 + r) % 5}" if i % 11 else None, (i * 37 + r) % 180, (i * 37 + r) % 180 + 6 + i % 3, i % 2, "ACGGCTAGC" * 25 + "GC" * r) for r in range(5) for i in range(24)]
    rows += [(7, "A", 3, 9, 1, "GCGC" * 30)]
    table = spark.createDataFrame([(*r, k % 3) for k, r in enumerate(rows)], SCHEMA + ", file int")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    model = ablation.default_predictor()

    def write(k):
        table.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(source)

    for k in (0, 1):
        write(k)
    got = incremental.run_incremental_pairs(spark, source, SCHEMA, target, model, [0], 40)
    seen = table.where("file < 2")
    want = ablation.pair_ablation(seen.drop("seq", "file"), seen.select("region", "seq").distinct(), model, [0], 40)
    assert got.columns == want.columns and text(got) == text(want) and got.count() > 0
    # A restart from the checkpoint adds nothing; a third file adds its pairs with the motifs of the others.
    assert text(incremental.run_incremental_pairs(spark, source, SCHEMA, target, model, [0], 40)) == text(want)
    write(2)
    whole = ablation.pair_ablation(table.drop("seq", "file"), table.select("region", "seq").distinct(), model, [0], 40)
    got = incremental.run_incremental_pairs(spark, source, SCHEMA, target, model, [0], 40)
    assert text(got) == text(whole)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    per_file = sum(ablation.motif_pairs(table.where(F.col("file") == k), 40, ["pass_threshold_t0"]).count() for k in range(3))
    assert per_file < whole.count()


@pytest.mark.parametrize("extra", [[], [5]])
def test_stream_without_files(spark, tmp_path, extra):
    (tmp_path / "in").mkdir()
    run = incremental.run_incremental_pairs if extra else incremental.run_incremental
    out = run(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), ablation.default_predictor(), [0], *extra)
    assert out.count() == 0 and "region" in out.columns
