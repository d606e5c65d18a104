"""A local line from moments of cells equals the one from pairs of times: gaps, equal times and rows, missing keys, times and labels."""

import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators.neighbors import local_line


def rows():
    rng, out, t = random.Random(6), [], -40_000.0
    for i in range(700):
        t += rng.choice([0, 0, 1, 30, 60.5, 300, 900, 2700, 21600, 50_000 if i % 50 == 0 else 5])
        out.append((rng.choice(["a", "a", "a", "b", None]), None if i % 97 == 0 else t, i, None if i % 61 == 0 else round(rng.uniform(100, 400), 3), i % 3 > 0))
    return out + out[50:60] + [("c", 5.0, 900, 2.0, True), ("d", 7.0, 901, 2.5, False)]


def test_cells_equal_pairs(spark):
    df = spark.createDataFrame(rows(), "g string, t double, id long, y double, taught boolean").cache()
    line = lambda dense: sorted(map(tuple, local_line(df, df.filter("taught"), ["g"], "t", "id", "y", 6.0, F.col("taught"), "L_", dense).collect()), key=str)
    got, want = line(0.0), line(1e9)
    assert len(got) == len(want) == len(rows())
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and all(x is None if y is None else x == pytest.approx(y, rel=1e-6, abs=1e-6) for x, y in zip(a[5:], b[5:])), (a, b)


def test_dense_times_meet_no_pairs(spark):
    df = spark.range(3000).select(F.col("id").alias("run_id"), F.lit("a").alias("k"), (F.col("id") * 20.0).alias("t"), (F.col("id") % 7.0).alias("y"))
    plan = local_line(df, df, ["k"], "t", "run_id", "y", 6.0, F.lit(True), "L_")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
