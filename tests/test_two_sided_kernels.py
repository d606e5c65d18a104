"""Two-sided kernel means by times and by cells, against all pairs: gaps of many widths, equal times, own labels, no labels."""

import math
import random

import pytest

from fleetspark.operators import arrivals as A

CLOCKS = {"ahead": A.Clock(delay=3600.0, lag=6 * 3600.0), "past": A.Clock(delay=3600.0, lag=0.0)}


def rows():
    rng, out, t = random.Random(5), [], 0
    for i in range(220):
        t += rng.choice([0, 0, 1, 60, 900, 5000, 40_000, 900_000])
        out.append(("ab"[i % 7 == 0], float(t), i, round(rng.uniform(1, 9), 3), rng.random() < 0.7))
    return out


def by_pairs(data, clock, h):
    found = {}
    for key, t, i, _, _ in data:
        seen = [(abs(t - b[1]) / (h * 3600), b[3]) for b in data
                if b[0] == key and b[4] and b[2] != i and b[1] <= t + clock.lag - clock.delay]
        if seen:
            z = min(d for d, _ in seen)
            w = [math.exp(-0.5 * (d - z) * (d + z)) for d, _ in seen]
            found[i] = sum(a * y for a, (_, y) in zip(w, seen)) / sum(w)
    return found


@pytest.mark.parametrize("clock", CLOCKS)
@pytest.mark.parametrize("dense_times", [0.0, 1e9])
def test_kernel_means_equal_all_pairs(spark, clock, dense_times):
    data, clock = rows(), CLOCKS[clock]
    df = spark.createDataFrame(data, "regime string, t_end double, run_id long, y double, measured boolean")
    out = A.two_sided(df, df.filter("measured"), ["regime"], clock, widths=(0.25, 4.0), dense_times=dense_times).collect()
    assert len(out) == len(data)
    for name, h in (("K025", 0.25), ("K4", 4.0)):
        want = by_pairs(data, clock, h)
        for r in out:
            if r["run_id"] in want:
                assert r[name] == pytest.approx(want[r["run_id"]], rel=1e-8), (name, r["run_id"])
            else:
                assert r[name] is None


@pytest.mark.parametrize("dense_times", [0.0, 1e9])
def test_no_labels_give_nulls(spark, dense_times):
    df = spark.createDataFrame([("a", 1.0, 1, None, False), ("a", 9.0, 2, None, False)], "regime string, t_end double, run_id long, y double, measured boolean")
    out = A.two_sided(df, df.filter("measured"), ["regime"], CLOCKS["ahead"], widths=(1.0,), dense_times=dense_times).collect()
    assert [r["K1"] for r in out] == [None, None]
