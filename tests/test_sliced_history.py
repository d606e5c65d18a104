"""Decayed sums and running columns of cut keys: one scan for all half-lives, states of slices broadcast, equal to plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from fleetspark.operators.neighbors import ewm_states
from fleetspark.operators.ordered import Ordered

HOURS, COUNTS = {"a": 40.0, "b": 400.0, "c": 3000.0}, {"d": 2.0, "e": 15.0}


@pytest.fixture(scope="module")
def labels(spark):
    """A hot key, small ones and a missing one; equal times and missing labels."""
    rnd = random.Random(8)
    rows = [(rnd.choice(["hot"] * 8 + ["k", None]), float(rnd.randrange(3000)), i, None if rnd.random() < 0.1 else rnd.gauss(150, 20))
            for i in range(900)]
    return spark.createDataFrame(rows, "k string, t double, id long, y double").cache()


def test_decayed_sums_of_slices_equal_a_loop(labels):
    cut = ewm_states(labels, ["k"], "t", ["id"], "y", HOURS, COUNTS, 40)
    got = {r["id"]: [r[f"{c}_{n}"] for c in "sw" for n in (*HOURS, *COUNTS)] for r in cut.collect()}
    rows = sorted(labels.collect(), key=lambda r: (r["k"] or "", r["t"], r["id"]))
    assert len(got) == len(rows)
    last = None
    for r in rows:
        if last is None or r["k"] != last["k"]:
            s, w = [0.0] * 5, [0.0] * 5
            last = r
        decay = [2 ** ((last["t"] - r["t"]) / h) for h in HOURS.values()] + [2 ** (-1 / h) for h in COUNTS.values()]
        s, w = [a * d + (r["y"] or 0.0) for a, d in zip(s, decay)], [a * d + 1 for a, d in zip(w, decay)]
        assert got[r["id"]] == pytest.approx([*s, *w], rel=1e-9)
        last = r


def test_decayed_sums_read_their_input_once(labels):
    plan = ewm_states(labels.withColumn("z", F.col("y") + 1), ["k"], "t", ["id"], "z", HOURS, COUNTS, 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan  # it goes on from the stored scan


def test_running_leaves_rows_where_they_are(labels):
    o = Ordered(labels, ["k"], "t", ["id"], 40).running({"n": ("count", F.lit(1))})
    plan = o.df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
