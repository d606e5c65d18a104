"""Wide lists and copies stay out of the rows: before/after events, schedules, the past block; whole keys and slices."""

import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators import arrivals as A
from fleetspark.operators import asof, runs, stats


def made(spark, n=900, seed=3):
    r = random.Random(seed)
    rows = [(i, r.choice("ab"), float(r.randrange(0, 400_000)), r.gauss(5, 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, g string, t double, y double")


@pytest.mark.parametrize("chunk", [1000000, 200])
def test_events_meet_row_numbers_not_lists(spark, monkeypatch, chunk):
    monkeypatch.setattr(asof, "recent_lists", lambda *a, **k: pytest.fail("a list was kept for every row"))
    spark.conf.set("fleetspark.chunkRows", str(chunk))
    try:
        rows, df = made(spark)
        times = [("a", rows[7][2] if rows[7][1] == "a" else 5e4), ("a", -1.0), ("b", 2e5), ("b", 1e9)]
        got = {(r["g"], r["event_t"]): r for r in stats.before_after(df, spark.createDataFrame(times, "g string, t double"), ["g"], "t", ["id"], "y", 20).collect()}
    finally:
        spark.conf.unset("fleetspark.chunkRows")
    for g, at in times:
        own = sorted((t, i, y) for i, k, t, y in rows if k == g)
        b, a = [y for t, _, y in own if t < at][-20:], [y for t, _, y in own if t >= at][:20]
        r = got[g, at]
        assert r["before"] == (pytest.approx(sum(b) / len(b)) if b else None) and r["after"] == (pytest.approx(sum(a) / len(a)) if a else None)
        assert (r["t_stat"] is not None) == (len(a) > 1 and len(b) > 1)
    assert len(got) == 4


@pytest.mark.parametrize("chunk", [1000000, 200])
def test_schedule_joins_no_spells(spark, monkeypatch, chunk):
    rows, df = made(spark)
    df = df.withColumn("e", F.col("t") + 100 + F.col("id") % 300)
    monkeypatch.setattr(runs, "join_keys", lambda *a, **k: pytest.fail("rows joined with their spells"))
    spark.conf.set("fleetspark.chunkRows", str(chunk))
    try:
        got = {r["id"]: r for r in runs.schedule(df, ["g"], "t", "e", ["id"], 900.0).collect()}
    finally:
        spark.conf.unset("fleetspark.chunkRows")
    for g in "ab":
        own, top, last, spells, lots = sorted((t, i) for i, k, t, _ in rows if k == g), None, None, [], []
        for t, i in own:
            if top is None or t - top > 900:
                spells.append([])
            if last is None or t - last > 600:
                lots.append([])
            spells[-1].append(i), lots[-1].append(i)
            top, last = max(top or 0, t + 100 + i % 300), t
        for name, parts in (("spell", spells), ("lot", lots)):
            for k, part in enumerate(parts):
                for pos, i in enumerate(part):
                    assert (got[i][name], got[i][f"{name}_pos"], got[i][f"{name}_len"]) == (k + 1, pos, len(part))


def test_past_block_makes_what_is_asked(spark, monkeypatch):
    _, df = made(spark)
    clock = A.Clock(t="t", tie="id", delay=3600.0)
    some = ["P_last1", "P_mean3", "P_mean10", "P_age1"]
    whole = A.past_block(df, df, ["g"], clock).select("id", *some).collect()
    monkeypatch.setattr(A, "ewm_states", lambda *a, **k: pytest.fail("decayed sums for nothing"))
    monkeypatch.setattr(A, "range_counts", lambda *a, **k: pytest.fail("counts for nothing"))
    out = A.past_block(df, df, ["g"], clock, only=some)
    assert out.columns == [*df.columns, *some] and sorted(out.select("id", *some).collect()) == sorted(whole)


@pytest.mark.parametrize("chunk", [1000000, 200])
def test_equal_rows_keep_one_order(spark, chunk):
    _, df = made(spark, 400)
    df = df.unionByName(df).withColumn("e", F.col("t") + 100)
    spark.conf.set("fleetspark.chunkRows", str(chunk))
    try:
        out = runs.schedule(df, ["g"], "t", "e", ["id"], 900.0).groupBy("g", "spell").agg(F.count(F.lit(1)).alias("n"), F.min("spell_len").alias("a"), F.max("spell_len").alias("b"),
                                                                                          F.countDistinct("spell_pos").alias("p")).collect()
    finally:
        spark.conf.unset("fleetspark.chunkRows")
    assert out and all(r["n"] == r["a"] == r["b"] == r["p"] for r in out)
