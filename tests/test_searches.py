"""Searches over whole grids, against plain Python."""

import math
import random

import pytest

from fleetspark.operators import ml
from fleetspark.operators import neighbors as N
from fleetspark.plans import filter_queries as FQ
from fleetspark.plans import ml_queries as MQ
from fleetspark.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.001"

QHS, QJS = (0.003, 0.01, 0.03, 0.1, 0.3, 1.0), (0.0, 0.1, 0.3, 1.0, 3.0)


def grown(seconds, qh, qj):
    return qh * seconds / 3600 + (qj if seconds / 3600 > 0.25 else 0)


def forward(rows, qh, qj):
    """(m, p, innovation, s) after each of the rows (t, y)."""
    out = [(rows[0][1], 1.0, None, None)]
    for (t0, _), (t, y) in zip(rows, rows[1:]):
        m, p = out[-1][0], out[-1][1] + grown(t - t0, qh, qj)
        out.append((m + p / (p + 1) * (y - m), p / (p + 1), y - m, p + 1))
    return out


def smoothed(rows, i, f, qh, qj, window=18000):
    t = rows[i][0]
    ahead = [(-u, y) for u, y in rows[i + 1:i + 200] if u <= t + window][::-1]
    parts = [(f[i - 1][0], f[i - 1][1] + grown(t - rows[i - 1][0], qh, qj))] if i else []
    if ahead:
        m, p = forward(ahead, qh, qj)[-1][:2]
        parts.append((m, p + grown(-ahead[-1][0] - t, qh, qj)))
    return sum(m / p for m, p in parts) / sum(1 / p for _, p in parts) if parts else None


@pytest.fixture(scope="module")
def labelled(spark):
    by = {}
    for r in FQ.labels(spark, DATA).select("regime", "t_end", "run_id", "y").collect():
        by.setdefault(r["regime"], []).append((r["t_end"], r["run_id"], float(r["y"])))
    return {k: [(t, y) for t, _, y in sorted(v)] for k, v in by.items()}


def test_noise_ratio_is_chosen_over_the_whole_grid(spark, labelled):
    got = {r["regime"]: r for r in QUERIES["noise_ratio_selection"](spark, DATA).collect()}
    for regime, rows in labelled.items():
        best = []
        for qh in QHS:
            for qj in QJS:
                f = forward(rows, qh, qj)
                e = [(smoothed(rows, i, f, qh, qj), y) for i, (t, y) in enumerate(rows) if t < 36000000]
                e = [(m - y) ** 2 for m, y in e if m is not None]
                best.append((sum(e) / len(e), qh, qj))
        r = got[regime]
        assert r["mse"] == pytest.approx(min(best)[0], rel=1e-6)
        assert [m for m, qh, qj in best if (qh, qj) == (r["qh"], r["qj"])] == [pytest.approx(r["mse"], rel=1e-6)]


def test_noise_likelihood_is_compared_over_the_whole_grid(spark, labelled):
    got = {r["regime"]: r for r in QUERIES["noise_ratio_likelihood"](spark, DATA).collect()}
    for regime, rows in labelled.items():
        best = []
        for qh in QHS:
            for qj in QJS:
                x = forward(rows, qh, qj)[1:]
                v = sum(e * e / s for _, _, e, s in x) / len(x)
                best.append((-0.5 * (len(x) * math.log(v) + sum(math.log(s) for *_, s in x)), qh, qj))
        assert (got[regime]["loglik"], got[regime]["qh"], got[regime]["qj"]) == pytest.approx(max(best), rel=1e-6)


def greedy(points, scales, ks, passes=2):
    """Scales and k by coordinate search on (state, y, key), with the predictor under them."""
    d = len(points[0][0])
    n = len(points)
    means = [sum(p[0][c] for p in points) / n for c in range(d)]
    std = [math.sqrt(sum((p[0][c] - means[c]) ** 2 for p in points) / (n - 1)) for c in range(d)]

    def pred(i, w, k):
        near = sorted((round(math.sqrt(sum(((points[i][0][c] - q[0][c]) * w[c] / std[c]) ** 2 for c in range(d))), 9), j)
                      for j, q in enumerate(points) if j != i and q[2] == points[i][2])[:k]
        return sum(points[j][1] / (x + 1e-3) for x, j in near) / sum(1 / (x + 1e-3) for x, _ in near)

    loss = lambda w, k: sum((pred(i, w, k) - points[i][1]) ** 2 for i in range(n)) / n
    w, k = [1.0] * d, 5
    best = loss(w, k)
    for _ in range(passes):
        for c in range(d):
            for s in scales:
                t = [*w[:c], s, *w[c + 1:]]
                if (v := loss(t, k)) < best - 1e-9:
                    best, w = v, t
        for t in ks:
            if (v := loss(w, t)) < best - 1e-9:
                best, k = v, t
    return w, k, [pred(i, w, k) for i in range(n)]


def test_state_search_chooses_scales_and_k(spark):
    r = random.Random(8)
    points = [((r.random(), r.random() * 9, r.random() * 50, r.random()), 0.0, r.choice("ab")) for _ in range(70)]
    points = [(x, x[0] * 3 + math.sin(x[1]) + r.random() * 0.6, g) for x, _, g in points]
    w, k, want = greedy(points, (0.0, 0.5, 1.0, 2.0, 4.0), (3, 5, 10))
    df = spark.createDataFrame([(i, *x, y, g) for i, (x, y, g) in enumerate(points)], "id long, a double, b double, c double, d double, y double, g string")
    got = {x["id"]: x["pred"] for x in N.weighted_state_regressor(df, df, ["g"], ["a", "b", "c", "d"], "id", "y", MQ.SCALES, MQ.KS).collect()}
    assert w != [1.0] * 4 and [got[i] for i in range(70)] == pytest.approx(want, rel=1e-6)


def test_registered_searches_are_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(N, "weighted_state_regressor", lambda q, c, keys, state, tie, y, scales, ks, rows: seen.append((set(state), scales, ks)) or q)
    QUERIES["weighted_state_regressor"](spark, DATA)
    assert seen == [({"hours", "usage", "pad", "film", "duration"}, [0.0, 0.5, 1.0, 2.0, 4.0], [3, 5, 10])]
    fitted = []

    def fit(train, test, cols, label, fold, cap, grid, out):
        fitted.append((label, math.prod(map(len, grid.values()))))
        return test.withColumn(out, test["t"])

    monkeypatch.setattr(ml, "fit_regressor_by_folds", fit)
    out = QUERIES["ttf_regressor_by_tool_folds"](spark, DATA)
    assert fitted == [("ttf_0", 4), ("ttf_1", 4), ("ttf_2", 4)] and out.columns == ["tool", "id", "pred_0", "pred_1", "pred_2"]
