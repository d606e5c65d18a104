"""Kernel sums against all pairs: equal times, null times, keys and labels, far gaps, blocks cut into batches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import neighbors as N

SCHEMA = "k string, t double, id long, y double, ref boolean"


def rows():
    rng, out, t = random.Random(3), [], -50_000.0
    for i in range(300):
        t += rng.choice([0, 0, 1, 40, 900, 2500, 60_000])
        out.append((("a", "b", None)[i % 11 % 3], None if i % 41 == 5 else t, i, None if i % 29 == 3 else rng.uniform(1, 9), rng.random() < 0.6))
    return out


def by_pairs(data, h):
    found = {}
    for k, t, i, _, _ in data:
        near = [] if t is None else [(math.exp(-0.5 * ((t - b[1]) / (h * 3600)) ** 2), b[3]) for b in data
                                      if b[4] and b[2] != i and b[1] is not None and b[0] == k and (k is not None or b[1] == t) and abs(b[1] - t) <= 9 * h * 3600]
        found[i] = sum(w for w, _ in near), sum(w * (y or 0) for w, y in near)
    return found


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_gaussian_sums_equal_all_pairs(spark, batch):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = N.kernel_sums(df, df.filter("ref"), ["k"], "t", "y", {"a": ("gauss", 0.5), "b": ("gauss", 6.0)}, F.col("ref")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(data)
    for name, h in (("a", 0.5), ("b", 6.0)):
        want = by_pairs(data, h)
        for r in out:
            if r["t"] is not None:
                w, s = want[r["id"]]
                assert r[f"n_{name}"] == pytest.approx(w, abs=1e-9)
                assert r[f"k_{name}"] == (pytest.approx(s / w, rel=1e-8, abs=1e-8) if w >= N.MIN_WEIGHT else None)


def test_places_are_not_multiplied_and_nothing_is_broadcast(spark):
    """The old plan made 37 rows of each place and broadcast them, because the size of a small file hides them."""
    df = spark.range(500).select(F.lit("a").alias("k"), (F.col("id") * 60.0).alias("t"), "id", F.lit(1.0).alias("y"), F.lit(True).alias("ref"))
    out = N.kernel_sums(df, df, ["k"], "t", "y", {"a": ("gauss", 1.0)}, F.lit(True))
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and plan.count("explode(sequence") <= 2
