"""The grid of noise ratios is scored side by side: rows are not copied for each pair, whatever lies in a block."""

import random

import pytest

from fleetspark.operators import filters as FL

QHS, QJS = [0.01, 0.1, 1.0], [0.0, 0.3]


def made(spark, seed=4):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), float(r.randrange(0, 40_000)) if r.random() < 0.8 else float(r.randrange(90_000, 91_000)), r.gauss(5, 2)) for i in range(300)]
    rows += [(400, "c", 100.0, 1.0), (401, "d", None, 2.0), (402, "a", None, 7.5), (403, "a", None, 3.5)]
    rows += [(500 + i, "e", 900.0 * i, None if i == 30 else float(i % 7)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, g string, t double, y double")


def test_blocks_give_the_errors_of_copies(spark):
    df = made(spark)
    args = (df.filter("t < 90500"), df.filter("id % 3 > 0"), ["g"], "t", "id", "y", QHS, QJS, 5000.0)
    want = {(r["g"], r["qh"], r["qj"]): r["mse"] for r in FL._errors_of_copies(*args, None).collect()}
    got = {(r["g"], r["qh"], r["qj"]): r["mse"] for r in FL._errors_of_blocks(*args).collect()}
    assert got.keys() - want.keys() == set() and {k[0] for k in want} - {k[0] for k in got} == set()
    assert got == {k: pytest.approx(v, rel=1e-6) if v is not None else None for k, v in want.items()}


def test_rows_are_not_copied_for_each_pair(spark, monkeypatch):
    def copies(*_):
        raise AssertionError("rows copied for each pair")

    df = made(spark)
    monkeypatch.setattr(FL, "noise_grid", copies)
    assert FL.select_noise(df, df, ["g"], "t", "id", "y", QHS, QJS, 5000.0).count() == 4  # d has no row with a time
