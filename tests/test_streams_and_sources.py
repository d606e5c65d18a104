"""Streams over several micro-batches with a restart, and CSV files whose columns differ."""

import os

import pytest
from pyspark.sql import functions as F

from fleetspark.sources import runs as RS
from fleetspark.sources import telemetry as TE
from fleetspark.streaming import jobs as J
from fleetspark.streaming import processors as P
from fleetspark.streaming.service import RefitService

EVENT = "tool long, id long, t double, flag boolean"
RUN = "scenario string, regime string, run_id long, kind int, at double, t double, y double, z double, u double"


def test_event_before_a_late_row(spark):
    """A row at 150 that arrives after events at 100 and 200 is 50 behind the first one."""
    feed = J.Feed(spark, spark.createDataFrame([], EVENT).schema)
    pieces = [spark.createDataFrame(rows, EVENT) for rows in ([(1, 1, 100.0, True)], [(1, 2, 200.0, True)], [(1, 3, 150.0, False), (1, 4, 90.0, False)])]
    got = {r["id"]: r["since"] for r in J.in_pieces(P.since_event, feed, pieces).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 50.0, 4: P.NO_EVENT}


def run_rows(n):
    out = []
    for i in range(n):
        t = 600.0 * i
        out.append(("s", "r", i, 1, t, t, 10.0 + i % 5, float(i % 5) if i % 11 else None, (i % 10) / 10))
        out.append(("s", "r", i, 0, t + 900.0, t, 10.0 + i % 5, float(i % 5), (i % 10) / 10))
    return sorted(out, key=lambda r: r[4])


def test_labels_and_policies(spark):
    rows = run_rows(60)
    feed = J.Feed(spark, spark.createDataFrame([], RUN).schema)
    pieces = [spark.createDataFrame(rows[i:i + 24], RUN) for i in range(0, len(rows), 24)]
    out = J.in_pieces(lambda s: P.arrived_labels(s, policies={"s": {"policy": "random", "budget": 0.35}}), feed, pieces).filter("kind = 'run'").collect()
    for r in out:
        known = [y for _, _, i, kind, at, _, y, _, u in rows if kind == 0 and at < r["at"] and u < 0.35]
        assert r["n"] == len(known) and r["chosen"] == (r["run_id"] % 10 < 4)
        assert r["mean"] == (pytest.approx(sum(known) / len(known)) if known else None)


def test_refused_labels_stay_unknown(spark):
    """Labels that come eight days late: those of refused runs are not learned, those of chosen ones are."""
    day = 86400.0
    rows = [("s", "r", i, 1, 600.0 * i, 600.0 * i, 10.0 + i, 0.0, i / 10) for i in range(10)]
    rows += [("s", "r", i, 0, 8 * day + 600.0 * i, 600.0 * i, 10.0 + i, 0.0, i / 10) for i in range(10)]
    rows += [("s", "r", 100 + i, 1, t, t, 0.0, 0.0, 0.99) for i, t in enumerate((7.9 * day, 9 * day))]
    feed = J.Feed(spark, spark.createDataFrame([], RUN).schema)
    rows.sort(key=lambda r: r[4])
    pieces = [spark.createDataFrame(rows[i:i + 6], RUN) for i in range(0, len(rows), 6)]
    out = J.in_pieces(lambda s: P.arrived_labels(s, policies={"s": {"policy": "random", "budget": 0.35}}), feed, pieces).filter("run_id = 101").collect()
    assert [(r["n"], r["mean"]) for r in out] == [(4, pytest.approx(11.5))]


def test_service_predicts_after_the_first_refit(spark):
    rows = run_rows(60)
    feed = J.Feed(spark, spark.createDataFrame([], RUN).schema)
    pieces = [spark.createDataFrame(rows[i:i + 20], RUN) for i in range(0, len(rows), 20)]
    service = RefitService(spark, ["z"], "y", least=10, ridge=1e-6)
    J.in_pieces(lambda s: s, feed, pieces, service)
    out = service.scored(feed.schema).collect()
    assert len(out) == 60
    first = min(r["batch"] for r in out if r["pred"] is not None)
    for r in out:
        assert (r["pred"] is None) == (r["batch"] < first)
        if r["pred"] is not None and r["z"] is not None:
            assert r["pred"] == pytest.approx(r["y"], abs=0.01)
    again = RefitService(spark, ["z"], "y", folder=service.sums.rsplit("/", 1)[0])
    assert again.model()["refit"] == service.model()["refit"]


def test_columns_by_name(spark, tmp_path):
    for name, text in (("a_DC_train", "time,s1,s2\n1,10,20\n"), ("b_DC_train", "time,s2,s1\n1,21,11\n"), ("c_DC_train", "s1,time\n12,1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = {r["tool"]: (r["time"], r["s1"], r["s2"]) for r in TE.read_telemetry(spark, str(tmp_path), ["s1", "s2"]).collect()}
    assert got == {"a": (1.0, 10.0, 20.0), "b": (1.0, 11.0, 21.0), "c": (1.0, 12.0, None)}
    with pytest.raises(ValueError):
        TE.read_ttf(spark, str(tmp_path), ["s2"])
    out = RS.read_runs(spark, {"train": str(tmp_path)}, "s2 double, s1 long, other string").collect()
    assert sorted(((r["s1"], r["s2"]) for r in out), key=repr) == [(10, 20.0), (11, 21.0), (12, None)]


def test_pairs_come_from_names(spark, tmp_path):
    for folder, names in (("s", "ab"), ("l", "bc")):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}_DC.csv").write_text("not,a,table")
    assert TE.pair_sources(spark, str(tmp_path / "s"), str(tmp_path / "l")) == (["b"], ["a"])


def test_one_file_a_partition_unless_hot(spark, tmp_path):
    df = spark.range(120).select((F.col("id") % 3).alias("tool"), (F.col("id") * 86400.0).alias("time"), "id")
    files = lambda d: [f for _, _, names in os.walk(d) for f in names if f.endswith(".parquet")]
    TE.write_partitioned(df, str(tmp_path / "a"), ["tool"], "time")
    assert len(files(tmp_path / "a")) == 3
    spark.conf.set("fleetspark.chunkRows", "30")
    try:
        TE.write_partitioned(df, str(tmp_path / "b"), ["tool"], "time")
    finally:
        spark.conf.unset("fleetspark.chunkRows")
    assert len(files(tmp_path / "b")) > 3
    for d in "ab":
        assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / d)).collect()) == list(range(120))


def test_headers_are_read_by_tasks(spark, tmp_path):
    """Many files, two headers, blanks and short rows; the driver opens none of them."""
    for i in range(40):
        (tmp_path / f"x{i}").mkdir()
        (tmp_path / f"x{i}" / f"t{i}_DC.csv").write_text(f"time,s1\n{i},{i + 1}\n{i}\n" if i % 2 else f"s1,extra,time\n,q,{i}\n")
    (tmp_path / "x0" / "none_DC.csv").write_text("")
    got = sorted((r["tool"], r["time"], r["s1"]) for r in TE.read_telemetry(spark, str(tmp_path), ["s1"]).na.fill(-1.0).collect())
    assert got == sorted([(f"t{i}", float(i), i + 1.0) for i in range(1, 40, 2)] + [(f"t{i}", float(i), -1.0) for i in range(40)])
    assert not hasattr(TE, "header_of") and TE.headers(spark, str(tmp_path)).count() == 40
