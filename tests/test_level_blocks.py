"""Fixed-lag smoothing by blocks of time equals the scans: equal times and rows, missing keys, times and labels, gaps of many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators.filters import fixed_lag_smoother

QH, QJ = 0.2, 0.1


def rows():
    rng, out, t = random.Random(4), [], 0.0
    for i in range(300):
        t += rng.choice([0, 0, 1, 60, 900, 5000, 90_000])
        out.append((rng.choice(["a", "a", "b", None]), None if i % 41 == 0 else t, i, round(rng.uniform(1, 9), 3), i % 3 > 0))
    return out + [("c", 5.0, 900, None, False), ("d", 7.0, 901, 2.5, True), ("d", None, 902, 3.5, True)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "g string, t double, id long, y double, taught boolean").cache()


def test_blocks_equal_scans(frame):
    labels = frame.filter("taught")
    both = [fixed_lag_smoother(frame, labels, ["g"], "t", "id", "y", a, b, 4000.0) for a, b in ((QH, QJ), (F.lit(QH), F.lit(QJ)))]
    assert both[0].columns == both[1].columns
    got, want = (sorted(map(tuple, x.collect()), key=str) for x in both)
    assert len(got) == len(want) == frame.count()
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and all(x == y if y is None else x == pytest.approx(y, rel=1e-7) for x, y in zip(a[5:], b[5:])), (a, b)


def test_blocks_store_no_stage_of_their_rows(frame, spark):
    """A key larger than a slice whose blocks are small is smoothed by blocks: no slices, no as-of lookups."""
    spark.conf.set("fleetspark.chunkRows", "100")
    try:
        plan = fixed_lag_smoother(frame, frame.filter("taught"), ["g"], "t", "id", "y", QH, QJ, 4000.0)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("fleetspark.chunkRows")
    assert "FlatMapGroupsInArrow" in plan
