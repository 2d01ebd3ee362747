"""Exact samples, rolling means and runs against plain Python, in one task and in many."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from coopspark.functions.scalars import name_prefix
from coopspark.operators import report, training, windows


@pytest.fixture
def parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_with_ties():
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(400), None if i % 50 == 0 else i) for i in range(300)]
    return rows + [("hot", 7, 7)] * 150  # a third of all rows are alike


@pytest.mark.parametrize("count", [1, 3, 8])
def test_first_rows_as_a_sort_and_limit(spark, parts, count):
    parts(count)
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows_with_ties())], "a string, b int, c int, i int").repartition(5)
    order = training.hash_order(["a", "b", "c"], 42)
    ranked = [tuple(r)[:3] for r in table.orderBy(order, "a", "b", "c").collect()]
    text = lambda rows: sorted(map(str, rows))
    first_hot = ranked.index(("hot", 7, 7))
    for n in (0, 1, 17, first_hot, first_hot + 1, first_hot + 75, first_hot + 150, 449, 450, 1000):
        got = training.sample_rows(table, n, ["a", "b", "c"]).collect()
        assert text(tuple(r)[:3] for r in got) == text(ranked[:n])
        assert len({r.i for r in got}) == len(got)
    plan = training.sample_rows(table, 17, ["a", "b", "c"])._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert training.sample_rows(table.limit(0), 5, ["a", "b", "c"]).count() == 0


@pytest.mark.parametrize("count", [1, 3, 8])
@pytest.mark.parametrize("width", [4, 7, 40])
def test_rolling_means_as_pandas(spark, parts, count, width):
    parts(count)
    rng = random.Random(width)
    rows = [(g, i, rng.choice([None, 1.0, 2.5, 4.0]) if i % 13 == 0 else float(rng.randrange(9))) for g in ("x", "y", None) for i in range(90 if g else 30)]
    table = spark.createDataFrame(rows, "g string, i int, v double").repartition(4)
    for group, block in (([], None), (["g"], None), (["g"], 3)):
        order = ["g", "i"] if not group else ["i"]
        got = windows.rolling_means(table, {"m": "v"}, order, width, group, block).toPandas()
        assert list(got.columns) == ["g", "i", "v", "m"]
        frame = pd.DataFrame(rows, columns=["g", "i", "v"]).fillna({"g": ""}).sort_values(["g", "i"])
        rolled = frame.v.rolling(width, center=True).mean() if not group else frame.groupby("g").v.transform(lambda v: v.rolling(width, center=True).mean())
        own = got.fillna({"g": ""}).sort_values(["g", "i"])
        assert own.m.round(9).fillna(-1).tolist() == rolled.round(9).fillna(-1).tolist()
    assert windows.rolling_means(table.limit(0), {"m": "v"}, ["i"], width).count() == 0


@pytest.mark.parametrize("count", [1, 3, 8])
def test_runs_over_partitions(spark, count):
    names = ["SOX2", "SOX9", "GATA1"] + [f"KLF{i}" for i in range(60)] + [None, None, "123", "123", "SOX1", "A1", "A2"]
    rows = [(g, i, n) for g in ("x", "y") for i, n in enumerate(names)]
    table = spark.createDataFrame(rows, "g string, i int, n string").repartition(3)
    prefix = {r.n: r.p for r in table.select("n", name_prefix(F.col("n")).alias("p")).collect()}

    def labels(axis):
        out = []
        for k, n in enumerate(axis):
            same = lambda j: 0 <= j < len(axis) and n is not None and axis[j] is not None and prefix[axis[j]] == prefix[n]  # noqa: B023, E731
            out.append("" if same(k - 1) else f"{prefix[n]}s" if same(k + 1) else n)
        return out

    got = report.compressed_labels(table, "n", "i", ["g"], count).orderBy("g", "i").collect()
    assert [r.label for r in got] == labels(names) * 2
    one = report.compressed_labels(table.where("g = 'x'"), "n", "i", parts=count).orderBy("i").collect()
    assert [r.label for r in one] == labels(names)
    assert report.compressed_labels(table.limit(0), "n", "i").count() == 0
