"""Literal values and leakage properties."""

import pytest
from pyspark.sql import functions as F

from fleetspark.functions import scalars as S
from fleetspark.operators import arrivals as A
from fleetspark.operators import blend as B
from fleetspark.operators import folds as FO
from fleetspark.operators import neighbors as N
from fleetspark.operators.bootstrap import paired_bootstrap
from fleetspark.operators.events import operating_state
from fleetspark.operators.ordered import WHOLE
from fleetspark.operators.rolling import rolling_stats
from fleetspark.operators.scoring import action_grid, cost_arrays, cost_matrix, decide
from fleetspark.operators.stats import _beta_tail
from fleetspark.operators.windows import window_labels, window_stats


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_penalty_cases(spark):
    df = table(spark, [(0.0, 100.0), (1000.0, 1000.0), (None, 1000.0), (500.0, None), (None, None)], "g double, p double")
    got = [r[0] for r in df.select(S.penalty_first("g", "p")).collect()]
    from math import exp
    assert got == pytest.approx([100.0, 0.0, exp(-1) * 1000, exp(-0.5) * 500, 0.0])


def test_ttf_classes(spark):
    df = table(spark, [(v,) for v in (0.0, 29.0, 30.0, 3599.0, 10799.0, 10800.0, None)], "g double")
    assert [r[0] for r in df.select(S.ttf_class("g")).collect()] == [0, 0, 1, 8, 11, 12, 12]


def test_window_stats_and_trend(spark):
    df = table(spark, [("a", 5.0 * i, float(i)) for i in range(8)], "tool string, t double, v double")
    r = window_stats(df, ["tool"], "t", ["v"], 20, trend_windows=48).orderBy("window").collect()
    assert [x.v_mean for x in r] == [1.5, 5.5] and [x.v_last for x in r] == [3.0, 7.0]
    assert r[0].v_trend is None and r[1].v_trend == 4.0 and r[0].n_samples == 4
    lab = table(spark, [("a", 0.0, 20.0), ("a", 5.0, 15.0), ("a", 10.0, 10.0), ("a", 15.0, None)], "tool string, t double, y double")
    assert window_labels(lab, ["tool"], "t", ["y"], 20).head().y == 10.0


def test_decisions(spark):
    train = table(spark, [(1195.0 + i % 11, 1.0) for i in range(200)] + [(None, 1.0)] * 50, "ttf double, w double")
    arrays = cost_arrays(cost_matrix(train, "ttf", "w", action_grid()), 13)
    sure = [0.0] * 13
    sure[6] = 1.0
    far = [0.0] * 12 + [1.0]
    got = decide(table(spark, [(0, sure), (1, far)], "i int, p array<double>"), "p", arrays).orderBy("i").collect()
    assert got[0].answer is not None and abs(got[0].answer - 1200) <= 20 and got[1].answer is None


def test_row_features_ignore_the_future(spark):
    rows = [("a", 4.0 * i, i, float(i % 7), "x" if i % 9 < 5 else "y") for i in range(120)]
    edited = [(k, t, i, v + (100 if i >= 80 else 0), c if i < 80 else "z") for k, t, i, v, c in rows]
    out = []
    for r in (rows, edited):
        df = table(spark, r, "tool string, t double, id long, v double, c string")
        df = rolling_stats(operating_state(df, ["tool"], "t", ["id"], ["c"], {"gap": 60}, WHOLE), ["tool"], "t", ["id"], [("v", "w", 75)], rows=WHOLE)
        out.append(df.filter("id < 80"))
    assert out[0].exceptAll(out[1]).count() == 0
    first = out[0].filter("id = 0").head()
    assert first.since_c_change == 0.0 and first.since_gap == 1e7


@pytest.fixture(scope="module")
def line(spark):
    """Runs every hour with label 10*i, five inner folds."""
    df = table(spark, [(i, "4A", 3600.0 * i, 10.0 * i, i % 4 != 3) for i in range(40)], "run_id long, regime string, t double, y double, ref boolean")
    return FO.kfold(df, ["run_id"], 5).cache()


def test_neighbors_exclude_self_and_recover_drift(spark, line):
    out = N.time_neighbors(line, line.filter("ref"), ["regime"], "t", "run_id", "y", rows=WHOLE).orderBy("run_id").collect()
    assert all(abs(r.NB_time_1 - r.y) >= 10 for r in out)
    mid = out[20]
    assert mid.NB_trend_15 == pytest.approx(200.0) and mid.NB_slope_15 == pytest.approx(10.0)


def test_labels_outside_the_references_are_invisible(spark, line):
    changed = line.withColumn("y", F.when(F.col("ref"), F.col("y")).otherwise(-999.0))
    cols = ["run_id", "NB_time_1", "NB_time_3", "NB_trend_15"]
    a, b = (N.time_neighbors(x, x.filter("ref"), ["regime"], "t", "run_id", "y", rows=WHOLE).select(cols) for x in (line, changed))
    assert a.exceptAll(b).count() == 0


def test_inner_folds_hide_own_fold(spark, line):
    q, c = FO.inner_views(line, F.col("ref"), "fold", 5)
    got = {r.run_id: r.NB_time_1 for r in N.time_neighbors(q, c, ["regime", "view"], "t", "run_id", "y", ks=(1,), trends=(), rows=WHOLE).collect()}
    rows = line.collect()
    for r in rows:
        pool = [x for x in rows if x.ref and x.run_id != r.run_id and (not r.ref or x.fold != r.fold)]
        best = min(abs(x.t - r.t) for x in pool)
        assert got[r.run_id] in [x.y for x in pool if abs(x.t - r.t) == best]


@pytest.mark.parametrize("lag", [0.0, 7200.0])
def test_arrival_rule(spark, line, lag):
    k = A.Clock("t", "run_id", "y", 3600.0, lag)
    df = line.withColumn("measured", F.col("ref"))
    cut = 3600.0 * 25
    late = df.withColumn("y", F.when(F.col("t") + 3600 > cut, F.col("y") + 500).otherwise(F.col("y")))
    outs = []
    for x in (df, late):
        o = A.past_block(x, x.filter("measured"), ["regime"], k, rows=WHOLE).drop("y")
        o = A.two_sided(o.join(x.select("run_id", "y"), "run_id"), x.filter("measured"), ["regime"], k, rows=WHOLE).drop("y")
        outs.append(o)
    early = F.col("t") + lag < cut  # issued before any changed label arrived
    assert outs[0].filter(early).exceptAll(outs[1].filter(early)).count() == 0
    assert outs[0].filter(~early).exceptAll(outs[1].filter(~early)).count() > 0


def test_weights_satisfy_optimality(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    y = rng.normal(100, 10, 200)
    P = np.column_stack([y + rng.normal(0, 2, 200), y + rng.normal(0, 4, 200), -y])
    G, b = P.T @ P, P.T @ y
    w = B.solve_weights(G, b)
    assert w.min() >= 0 and w.sum() == pytest.approx(1.0) and w[2] == 0.0
    x = w * (b @ w) / (w @ G @ w)  # undo the scaling along the ray
    slack = b - G @ x
    assert abs(slack[w > 0]).max() < 1e-2 * abs(b).max() and slack[w == 0].max() <= 0


def test_bootstrap_of_equal_errors_is_zero(spark):
    df = table(spark, [(i // 10, float(i % 13), float(i % 13)) for i in range(200)], "blk long, a double, b double")
    r = paired_bootstrap(df, "blk", "a", "b", 50).head()
    assert (r.n, r.n_blocks, r.delta, r.delta_lo, r.delta_hi, r.p_delta_lt0) == (200, 20, 0.0, 0.0, 0.0, 0.0)


def test_student_tail():
    assert _beta_tail(10 / (10 + 2.228138852 ** 2), 5, 0.5) == pytest.approx(0.05, abs=1e-6)


def test_state_neighbors_equal_brute_force(spark):
    import random
    rnd = random.Random(1)
    rows = [(i, "r", float(rnd.randrange(12)), rnd.gauss(0, 1) * (50 if i % 10 == 0 else 1), rnd.random(), float(i)) for i in range(150)]
    df = table(spark, rows, "id long, k string, a double, b double, c double, y double")
    got = N.state_neighbors(df, df.filter("id % 2 = 0"), ["k"], ["a", "b", "c"], "id", "y", 5, WHOLE).collect()
    for r in got:
        d = sorted((round(((r.a - q[2]) ** 2 + (r.b - q[3]) ** 2 + (r.c - q[4]) ** 2) ** 0.5, 9), q[0]) for q in rows if q[0] % 2 == 0 and q[0] != r.id)
        assert [(round(s.d, 9), s.id) for s in r._state] == d[:5]
