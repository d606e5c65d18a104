"""Online history against plain Python, with timers, nulls and a restart; progress records beyond the recent ones."""

import pytest

from fleetspark.streaming import history as H
from fleetspark.streaming import jobs as J
from fleetspark.scratch import new_path

ROW = "scenario string, regime string, run_id long, wafer long, life long, kind int, at double, t double, y double"
WAIT = 2 * 86400.0


def rows_of(n=120):
    """A run every two hours; labels come an hour later, every fifth never, and some runs have no wafer, life or label value."""
    out = []
    for i in range(n):
        t, regime = 7200.0 * (i + 1) + i % 3, "4A" if i % 2 == 0 else "4B"
        wafer = None if i % 13 == 0 else i // 2 if i % 7 else i // 2 - 40
        life = None if i % 17 == 0 else i // 40
        out.append(("s", regime, i, wafer, life, 1, t, t, None))
        if i % 5:
            out.append(("s", regime, i, wafer, life, 0, t + 3600, t, None if i % 11 == 0 else 10.0 + i % 4))
    return sorted(out, key=lambda r: r[6])


def expected(rows, run):
    _, regime, _, wafer, life, _, at, t, _ = run
    known = [r for r in rows if r[5] == 0 and r[6] < at and r[8] is not None]
    own, other = [r for r in known if r[1] == regime], [r for r in known if r[1] != regime]

    def decayed(labels, h):
        w = [0.5 ** ((at - r[7]) / 3600 / h) for r in labels]
        return sum(a * r[8] for a, r in zip(w, labels)) / sum(w) if sum(w) > 1e-3 else None
    same = [r[8] for r in own if life is not None and r[4] == life]
    partner = [r for r in other if wafer is not None and r[3] == wafer and r[6] >= at - WAIT]
    last = [r[8] for r in sorted(own, key=lambda r: (r[7], r[8]))]
    return {"n": len(own), "x_n": len(other), "life_n": len(same), "life_mean": sum(same) / len(same) if same else None,
            "partner_y": partner[-1][8] if partner else None, "mean3": sum(last[-3:]) / len(last[-3:]) if last else None,
            "n24": sum(r[7] >= at - 86400 for r in own), **{k: decayed(own, h) for k, h in H.HALF_LIVES.items()},
            **{f"x_{k}": decayed(other, h) for k, h in H.HALF_LIVES.items()}}


@pytest.fixture(scope="module")
def streamed(spark):
    def go(rows):
        feed = J.Feed(spark, spark.createDataFrame([], ROW).schema)
        size = len(rows) // 4 + 1
        pieces = [spark.createDataFrame(rows[i:i + size], ROW) for i in range(0, len(rows), size)]
        return {r["run_id"]: r.asDict() for r in J.in_pieces(lambda s: H.arrived_history(s, WAIT), feed, pieces).collect()}
    return go


def test_history_equals_brute_force(streamed):
    rows = rows_of()
    got = streamed(rows)
    runs = [r for r in rows if r[5] == 1]
    assert len(got) == len(runs)
    for run in runs:
        for name, value in expected(rows, run).items():
            assert got[run[2]][name] == (pytest.approx(value) if value is not None else None), (run, name)
    assert any(r["partner_y"] is not None for r in got.values())


def test_later_labels_change_nothing_before_them(streamed):
    rows = rows_of(40)
    cut = rows[len(rows) // 2][6]
    a = streamed(rows)
    b = streamed([r[:8] + (r[8] + 100.0,) if r[5] == 0 and r[6] >= cut and r[8] is not None else r for r in rows])
    assert all(a[i] == b[i] for i in a if a[i]["at"] <= cut)
    assert any(a[i] != b[i] for i in a)


def test_every_micro_batch_is_recorded(spark):
    feed = J.Feed(spark, spark.createDataFrame([], "a long").schema)
    for i in range(5):
        feed.add(spark.range(i + 1).withColumnRenamed("id", "a"))
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with J.ProgressLog(spark, new_path(spark, "progress")) as log:
            q, _ = J.run_available(feed.stream(), "append")
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
    assert len(q.recentProgress) <= 2
    got = sorted((r["batch"], r["input_rows"]) for r in log.records().collect() if r["input_rows"])
    assert got == [(i, i + 1) for i in range(5)]
