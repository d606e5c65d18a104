"""The hot-key path must give what plain windows give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetspark.operators.asof import asof, range_counts
from fleetspark.operators.filters import ewma_level, fixed_lag_smoother, likelihood, likelihood_grid, local_level, noise_grid
from fleetspark.operators.neighbors import ewm_features
from fleetspark.operators.ordered import WHOLE, Ordered
from fleetspark.operators.quantiles import quantiles
from fleetspark.operators.rolling import rolling_event_count, rolling_stats

ROWS = 40


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, a third of them at a single time."""
    rnd = random.Random(3)
    rows = []
    for i in range(700):
        key = "hot" if rnd.random() < 0.8 else f"k{i % 5}"
        t = 500.0 if rnd.random() < 0.33 else float(rnd.randrange(0, 3000))
        rows.append((key, t, i, rnd.gauss(0, 5) if rnd.random() > 0.1 else None))
    return spark.createDataFrame(rows, "k string, t double, id long, v double").cache()


def same(a, b, tol=1e-9):
    ra, rb = (sorted(map(tuple, x.select(*sorted(x.columns)).collect()), key=repr) for x in (a, b))
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for p, q in zip(x, y):
            if isinstance(p, float) and isinstance(q, float):
                assert abs(p - q) <= tol * max(1.0, abs(p)), (x, y)
            else:
                assert p == q, (x, y)


def test_slices_bound_rows_and_keep_order(skewed):
    o = Ordered(skewed, ["k"], "t", ["id"], ROWS)
    assert o.split
    assert o.df.groupBy(*o.part).count().agg(F.max("count")).head()[0] <= 3 * ROWS
    w = Window.partitionBy("k").orderBy("t", "id")
    assert o.df.withColumn("p", F.lag("_chunk").over(w)).filter("p > _chunk").count() == 0


@pytest.mark.parametrize("reverse,inclusive", [(False, True), (False, False), (True, True)])
def test_running_equals_plain_window(skewed, reverse, inclusive):
    specs = {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")),
             "l": ("last", F.col("v")), "g": ("lag", F.col("v"))}
    a, b = (Ordered(skewed, ["k"], "t", ["id"], r).running(specs, reverse, inclusive).result() for r in (ROWS, WHOLE))
    same(a, b)


@pytest.mark.parametrize("width", [5, 100])
def test_rolling_matches_direct_frames(skewed, width):
    got = rolling_stats(skewed, ["k"], "t", ["id"], [("v", "w", width)], rows=ROWS)
    f = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-(width - 1), 0)
    want = skewed.withColumns({"v_mean_w": F.avg("v").over(f), "v_std_w": F.stddev_samp("v").over(f), "v_min_w": F.min("v").over(f),
                               "v_max_w": F.max("v").over(f), "v_dev_w": F.col("v") - F.avg("v").over(f)})
    same(got, want, 1e-7)
    same(rolling_stats(skewed, ["k"], "t", ["id"], [("v", "w", width)], rows=WHOLE), want, 1e-7)


def test_event_counts(skewed):
    df = skewed.withColumn("e", F.col("v") > 0)
    got = rolling_event_count(df, ["k"], "t", ["id"], {"e": "e"}, {"w": 30}, ROWS)
    f = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-29, 0)
    same(got, df.withColumn("n_e_w", F.sum(F.when(F.col("e"), 1).otherwise(0)).over(f)))


def test_quantiles(skewed):
    qs = {"a": 0.1, "m": 0.5, "z": 0.93}
    same(quantiles(skewed, ["k"], ["v", "t"], qs, ROWS), quantiles(skewed, ["k"], ["v", "t"], qs, WHOLE))


def test_asof_and_range_counts(skewed):
    right = skewed.filter("id % 3 = 0")
    for side, inc in (("prev", False), ("prev", True), ("next", False), ("next", True)):
        a, b = (asof(skewed, right, ["k"], F.col("t"), F.col("t"), {"v": F.col("v"), "i": F.col("id")}, side=side, inclusive=inc,
                     rtie=F.col("id"), rows=r) for r in (ROWS, WHOLE))
        same(a, b)
    a = range_counts(skewed, ["k"], "t", ["id"], {"n": (-100.0, True, 0.0, False)}, rows=ROWS)
    rows = skewed.collect()
    want = {r.id: sum(1 for q in rows if q.k == r.k and r.t - 100 <= q.t < r.t) for r in rows}
    assert {r.id: r.n for r in a.collect()} == want


def test_decayed_means_equal_brute_force(skewed):
    df = skewed.filter("v is not null")
    for r in (ROWS, WHOLE):
        got = ewm_features(df, df.filter("id % 2 = 0"), ["k"], "t", "id", "v", {"h": 0.05}, {"c": 4.0}, "e_", rows=r).collect()
        rows = df.collect()
        for x in got[::17]:
            past = sorted([(q.t, q.id, q.v) for q in rows if q.k == x.k and q.id % 2 == 0 and q.t < x.t], reverse=True)
            w = [0.5 ** ((x.t - t) / 3600 / 0.05) for t, _, _ in past]
            c = [2.0 ** (-i / 4.0) for i in range(len(past))]
            for name, ws in (("e_h", w), ("e_c", c)):
                want = sum(a * p[2] for a, p in zip(ws, past)) / sum(ws) if sum(ws) >= 1e-3 else None
                assert (x[name] is None) == (want is None)
                assert want is None or abs(x[name] - want) < 1e-9


def test_scans_do_not_depend_on_slicing(skewed):
    df = skewed.filter("v is not null")
    same(*[ewma_level(df, ["k"], "t", ["id"], "v", 0.3, rows=r) for r in (ROWS, WHOLE)])
    same(*[local_level(df, ["k"], "t", "id", "v", F.lit(0.2), F.lit(0.1), r) for r in (ROWS, WHOLE)])
    same(*[fixed_lag_smoother(df, df.filter("id % 2 = 0"), ["k"], "t", "id", "v", F.lit(0.2), F.lit(0.1), 400.0, r) for r in (ROWS, WHOLE)], tol=1e-7)


def test_ties_are_cut_on_any_column(spark):
    """All rows at one instant and equal in the first tie column still go to several slices."""
    df = spark.range(400).select(F.lit("k").alias("k"), F.lit(5.0).alias("t"), F.lit(1).alias("a"), "id", (F.col("id") % 7).alias("v"))
    o = Ordered(df, ["k"], "t", ["a", "id"], ROWS)
    assert o.split and o.df.groupBy("_chunk").count().agg(F.max("count")).head()[0] <= 2 * ROWS
    got = {r["id"]: r["s"] for r in o.running({"s": ("sum", F.col("v"))}).result().collect()}
    assert got == {i: sum(j % 7 for j in range(i + 1)) for i in range(400)}


def test_groups_without_values_keep_their_row(spark):
    df = spark.createDataFrame([("a", 14.5), ("b", None)], "k string, v double")
    for rows in (1, WHOLE):
        assert sorted(tuple(r) for r in quantiles(df, ["k"], ["v"], {"m": 0.5}, rows).collect()) == [("a", 14.5), ("b", None)]


@pytest.mark.parametrize("r", [ROWS, WHOLE])
def test_likelihood_grid_equals_one_filter_per_pair(spark, r):
    """Whole keys and slices, a key with one label, a label that is null; no copy of the labels for each pair."""
    qhs, qjs = [0.01, 0.3], [0.0, 1.0]
    rng = random.Random(4)
    data = [("ab"[i % 3 == 0], rng.randrange(200_000) * 1.0, i, None if i == 899 else rng.uniform(1, 9)) for i in range(900)] + [("c", 5.0, 1000, 2.0)]
    df = spark.createDataFrame(data, "k string, t double, id long, v double")
    grid, keys = noise_grid(df, qhs, qjs), ["k", "qh", "qj"]
    f = local_level(grid, keys, "t", "id", "v", F.col("qh"), F.col("qj"), WHOLE)
    want = likelihood(f, keys, "t", "id", "v", F.col("qh"), F.col("qj"), WHOLE).select(*keys, "n", "noise", "loglik")
    got = likelihood_grid(df, ["k"], "t", "id", "v", qhs, qjs, r)
    a, b = (sorted((tuple(x) for x in d.collect()), key=lambda x: x[:3]) for d in (want, got))
    assert len(a) == len(b) == 12
    for x, z in zip(a, b):
        assert x[:4] == z[:4] and all(p == q or p == pytest.approx(q, rel=1e-8) for p, q in zip(x[4:], z[4:]))
