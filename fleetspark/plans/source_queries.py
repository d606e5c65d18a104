"""Sources, sinks, set operations and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clip, int_or_minus_one, select_by
from ..operators.folds import kfold
from ..operators.ordered import join_keys
from ..scratch import new_path
from ..sources import runs as RS
from ..sources import store as ST
from ..sources import telemetry as TE
from .blend_queries import M, MEMBERS, mem, members
from .neighbor_queries import FOLD_SQL
from .blend_queries import MEM_SQL
from .registry import query
from .run_queries import ANN, annotated
from .telemetry_queries import TTFS, TTF_SQL, LABELS_SQL, STATS_SQL, ttf
from .views import runs, sql, telemetry, faults


def csv_copy(spark, sf):
    """The telemetry view as CSV files in one folder per tool, the layout the readers expect."""
    path = new_path(spark, "csv")
    named = F.concat(F.format_string("%05d", "tool"), F.lit("_DC_train"))
    df = telemetry(spark, sf).withColumns({"file": named, "time": F.col("t"), "stage": F.when(F.col("id") % 7 == 0, "bad").otherwise(F.col("recipe_step").cast("string"))})
    df.select("file", "time", "id", "stage", "runnum", "s1", "s2").transform(TE.by_partition, ["file"], "time", 864000.0).write.partitionBy("file").option("header", True).csv(path)
    return path


def label_copy(spark, sf, tools="true"):
    path = new_path(spark, "ttf")
    named = F.concat(F.format_string("%05d", "tool"), F.lit("_DC_train"))
    df = ttf(spark, sf).filter(tools).withColumns({"file": named, "time": F.col("t")})
    df.select("file", "time", *TTFS).transform(TE.by_partition, ["file"]).write.partitionBy("file").option("header", True).csv(path)
    return path


TOOL = "printf('%05d', tool) AS tool"


@query("read_telemetry_csv", sql("telemetry", f"SELECT {TOOL}, count(*) AS n, min(t) AS t0, max(t) AS t1, avg(s1) AS s1, count(s2) AS n2, 0 AS n3 FROM telemetry GROUP BY 1", "tool", "t0 t1 s1", "n n2 n3"))
def _(spark, sf):
    df = TE.read_telemetry(spark, csv_copy(spark, sf), ["s1", "s2", "s_absent"])
    return df.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1"), F.avg("s1").alias("s1"),
                                  F.count("s2").alias("n2"), F.count("s_absent").alias("n3"))


@query("read_ttf_csv", sql("telemetry faults", f"+{TTF_SQL}, res AS (SELECT {TOOL}, count(*) AS n, sum(ttf_0) AS ttf_0, count(ttf_1) AS n1 FROM ttf GROUP BY 1)", "tool", "ttf_0", "n n1"))
def _(spark, sf):
    df = TE.read_ttf(spark, label_copy(spark, sf), TTFS)
    return df.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum("ttf_0").alias("ttf_0"), F.count("ttf_1").alias("n1"))


@query("pair_sources", sql("telemetry", f"SELECT DISTINCT {TOOL}, tool % 10 <> 0 AS paired FROM telemetry", "tool paired"))
def _(spark, sf):
    paired, alone = TE.pair_sources(spark, csv_copy(spark, sf), label_copy(spark, sf, "tool % 10 <> 0"))
    return spark.createDataFrame([(t, True) for t in paired] + [(t, False) for t in alone], "tool string, paired boolean")


@query("read_permuted_csv", sql("telemetry", f"""SELECT {TOOL}, count(*) AS n, sum(s1) AS s1, CASE WHEN tool % 3 < 2 THEN sum(s2) END AS s2, count(s2) FILTER (tool % 3 < 2) AS n2
  FROM telemetry GROUP BY tool""", "tool", "s1 s2", "n n2"))
def _(spark, sf):
    """Files whose columns come in another order, or lack one."""
    path = new_path(spark, "permuted")
    df = telemetry(spark, sf).withColumns({"file": F.concat(F.format_string("%05d", "tool"), F.lit("_DC_train")), "time": F.col("t")})
    for k, cols in enumerate((["time", "s1", "s2"], ["s2", "time", "s1"], ["s1", "time"])):
        df.filter(F.col("tool") % 3 == k).select("file", *cols).transform(TE.by_partition, ["file"]).write.mode("append").partitionBy("file").option("header", True).csv(path)
    got = TE.read_telemetry(spark, path, ["s1", "s2"])
    return got.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.count("s2").alias("n2"))


@query("ingest_typed_rows", sql("telemetry", f"SELECT {TOOL}, CAST(trunc(t) AS BIGINT) AS time, CASE WHEN id % 7 = 0 THEN -1 ELSE recipe_step END AS stage, runnum FROM telemetry", "tool", "", "time stage runnum"))
def _(spark, sf):
    out = new_path(spark, "rows")
    TE.write_partitioned(TE.typed_rows(spark, csv_copy(spark, sf), ["stage", "runnum"], ["s1", "s2"]), out, ["tool"], "time")
    return spark.read.schema("time long, stage long, runnum long, s1 float, s2 float, tool string").parquet(out).select("tool", "time", "stage", "runnum")


@query("cached_window_features", sql("telemetry faults", f"""+{TTF_SQL}, {LABELS_SQL}, res AS (SELECT tool, w AS "window", s1_mean, ttf_0, n_samples FROM ({STATS_SQL}) s JOIN labels_w USING (tool, w))""",
                                     'tool "window"', "s1_mean ttf_0", "n_samples"))
def _(spark, sf):
    path = new_path(spark, "windows")
    TE.ingest_windows(telemetry(spark, sf), ttf(spark, sf), path, ["s1", "s2"], TTFS, 86400.0, "t")
    return TE.load_windows(spark, path).select("tool", "window", "s1_mean", "ttf_0", "n_samples")


@query("count_only_scan", sql("runs", "SELECT split, count(*) AS n FROM runs GROUP BY split", "split", "", "n"))
def _(spark, sf):
    return runs(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("row_alignment_check", sql("telemetry faults", "SELECT tool, id, 1 AS left_rows, 0 AS right_rows FROM telemetry WHERE id % 500 = 3", "tool id", "", "left_rows right_rows"))
def _(spark, sf):
    return TE.mismatches(telemetry(spark, sf), ttf(spark, sf).filter("id % 500 <> 3"), ["tool", "id"])


RUN_CSV = "run_id long, wafer long, stage string, grp int, t_start double, y double"


@query("read_runs_by_split", sql("runs", "SELECT split, run_id, wafer, stage, t_start, y FROM runs", "split run_id wafer stage", "t_start y"))
def _(spark, sf):
    root = new_path(spark, "runs")
    df = runs(spark, sf).select("run_id", "wafer", "stage", "grp", "t_start", "y", "split")
    df.write.partitionBy("split").option("header", True).csv(root)
    got = RS.read_runs(spark, {s: f"{root}/split={s}" for s in ("train", "test", "val")}, RUN_CSV)
    return got.select("split", "run_id", "wafer", "stage", "t_start", "y")


@query("attach_labels_and_flag_outliers", sql("runs", """SELECT run_id, CASE WHEN is_ref THEN y END AS label, is_ref AND y > 450 AS big FROM runs""", "run_id big", "label"))
def _(spark, sf):
    df = runs(spark, sf)
    lab = df.filter("is_ref").select("run_id", (F.col("y") / 0.45).alias("label"))
    out = RS.attach_labels(df.drop("y"), lab, ["run_id"], "label")
    return out.select("run_id", F.col("outlier").alias("big"), (F.col("label") * 0.45).alias("label"))


@query("validated_one_to_one_join", sql("runs", "SELECT run_id, y, y AS y_r FROM runs", "run_id", "y y_r"))
def _(spark, sf):
    df = runs(spark, sf)
    return RS.one_to_one(df.select("run_id", "y"), df.select("run_id", "y", "usage"), ["run_id"], {"y": 1e-6}).select("run_id", "y", "y_r")


@query("unmeasured_complement", sql("runs", "SELECT run_id FROM runs WHERE NOT measured", "run_id"))
def _(spark, sf):
    df = runs(spark, sf)
    return RS.unmatched(df, df.filter("measured"), ["run_id"]).select("run_id")


@query("align_to_table", sql("runs run_rows", "SELECT r.run_id, p.n FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM run_rows GROUP BY 1) p USING (run_id)", "run_id", "", "n"))
def _(spark, sf):
    counts = annotated(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return RS.align_to(runs(spark, sf).select("run_id"), counts, ["run_id"])


@query("union_with_missing_columns", sql("runs", """SELECT run_id, split, CASE WHEN split <> 'val' THEN pad END AS pad, CASE WHEN split <> 'test' THEN film END AS film FROM runs""", "run_id split", "pad film"))
def _(spark, sf):
    df = runs(spark, sf)
    part = lambda s, *cols: df.filter(F.col("split") == s).select("run_id", "split", *cols)
    return RS.union_all([part("train", "pad", "film"), part("test", "pad"), part("val", "film")])


@query("set_difference_of_references", sql("runs", f"+{FOLD_SQL}, res AS (SELECT run_id FROM fo WHERE is_ref AND fold <> 2)", "run_id"))
def _(spark, sf):
    df = kfold(runs(spark, sf), ["run_id"], 5)
    return df.filter("is_ref").select("run_id").exceptAll(df.filter("is_ref and fold = 2").select("run_id"))


@query("common_rows", sql("runs", "SELECT run_id FROM runs WHERE measured AND is_ref", "run_id"))
def _(spark, sf):
    df = runs(spark, sf)
    return df.filter("measured").select("run_id").intersect(df.filter("is_ref").select("run_id"))


@query("prediction_export", sql("runs", f"+{M}, res AS (SELECT run_id, split, regime, round(pa + 1e-9, 3) AS pa, round(pb + 1e-9, 3) AS pb FROM mem)", "run_id split regime", "pa pb"))
def _(spark, sf):
    df = mem(spark, sf).withColumns({c: F.col(c) + 1e-9 for c in ("pa", "pb")})
    return ST.prediction_export(df, ["run_id", "split", "regime"], ["pa", "pb"])


@query("predictions_csv_and_last_row", sql("telemetry", "SELECT tool, max(t) AS t, arg_max(s1, t) AS pred FROM telemetry GROUP BY tool", "tool", "t pred"))
def _(spark, sf):
    path = new_path(spark, "predictions")
    ST.write_predictions(telemetry(spark, sf).select("tool", "id", "t", F.col("s1").alias("pred")), path)
    back = spark.read.schema("id long, t double, pred double, tool long").option("header", True).csv(path)
    return ST.last_predictions(back, "tool", "t", ["pred"], ["id"])


@query("member_prediction_store", sql("runs", f"""+{FOLD_SQL}, {MEM_SQL.format(src='fo')}, l AS (SELECT run_id, fold, member, pred FROM mem UNPIVOT INCLUDE NULLS (pred FOR member IN (pa, pb, pc))),
  res AS (SELECT fold, member, count(*) AS n, sum(pred) AS total FROM l GROUP BY ALL)""", "member", "total", "fold n"))
def _(spark, sf):
    path = new_path(spark, "members")
    ST.member_rows(members(kfold(runs(spark, sf), ["run_id"], 5)), ["run_id"], "fold", MEMBERS).write.partitionBy("member").parquet(path)
    return spark.read.parquet(path).groupBy("fold", "member").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("total"))


@query("member_store_audit", sql("runs", "SELECT run_id, 2 AS n, 1 AS folds FROM runs WHERE run_id % 100 = 7", "run_id", "", "n folds"))
def _(spark, sf):
    long = ST.member_rows(members(kfold(runs(spark, sf), ["run_id"], 5)), ["run_id"], "fold", MEMBERS)
    return ST.same_rows(long.filter("NOT (run_id % 100 = 7 AND member = 'pa')"), ["run_id"], "fold")


@query("metrics_json_round_trip", sql("runs", """+w AS (SELECT regime, avg(y) AS mean_y, stddev_samp(y) AS sd_y FROM runs GROUP BY regime),
  res AS (SELECT regime, metric, value FROM w UNPIVOT (value FOR metric IN (mean_y, sd_y)))""", "regime metric", "value"))
def _(spark, sf):
    wide = runs(spark, sf).groupBy("regime").agg(F.avg("y").alias("mean_y"), F.stddev_samp("y").alias("sd_y"))
    path = new_path(spark, "metrics")
    ST.write_metrics(ST.metric_rows(wide, ["regime"], ["mean_y", "sd_y"]), path)
    return ST.read_metrics(spark, path, "regime string, metric string, value double")


@query("feature_store", sql("run_rows", f"+{ANN}, res AS (SELECT run_id, avg(pressure) AS p FROM ann GROUP BY 1)", "run_id", "p"))
def _(spark, sf):
    from ..scratch import shared_dir
    build = lambda: annotated(spark, sf).groupBy("run_id").agg(F.avg("pressure").alias("p"))
    root = f"{shared_dir(spark)}/store"
    ST.stored(spark, root, "run_means", {"sf": sf, "agg": "mean"}, build)
    return ST.stored(spark, root, "run_means", {"sf": sf, "agg": "mean"}, build)


# -- projections --------------------------------------------------------------------------------------
@query("columns_known_before_the_run", sql("runs", "SELECT run_id, t_start, usage FROM runs", "run_id", "t_start usage"))
def _(spark, sf):
    df = runs(spark, sf)
    return df.select("run_id", *select_by(df.columns, prefixes=("t_start", "usage")))


@query("time_features", sql("runs", f"""SELECT run_id, t_start/3600 AS hours, (t_start - (SELECT min(t_start) FROM runs))/86400 AS day, sin((t_start % 86400)/86400*2*pi()) AS hod_sin,
  cos((t_start % 86400)/86400*2*pi()) AS hod_cos FROM runs""", "run_id", "hours day hod_sin hod_cos"))
def _(spark, sf):
    df = runs(spark, sf)
    x = join_keys(df, df.agg(F.min("t_start").alias("_t0")), [])
    ang = (F.col("t_start") % 86400) / 86400 * 2 * F.lit(3.141592653589793)
    return x.select("run_id", (F.col("t_start") / 3600).alias("hours"), ((F.col("t_start") - F.col("_t0")) / 86400).alias("day"),
                    F.sin(ang).alias("hod_sin"), F.cos(ang).alias("hod_cos"))


@query("ratio_and_interaction_features", sql("runs", """SELECT run_id, usage/greatest(duration, 1) AS usage_rate, usage*pad/1e4 AS usage_x_pad, usage/greatest(pad, 1) AS usage_over_pad,
  usage < 100 AS worn_in, usage*usage AS usage_sq FROM runs""", "run_id worn_in", "usage_rate usage_x_pad usage_over_pad usage_sq"))
def _(spark, sf):
    u, p, one = F.col("usage"), F.col("pad"), F.lit(1.0)
    return runs(spark, sf).select("run_id", (u / F.greatest(F.col("duration"), one)).alias("usage_rate"), (u * p / 1e4).alias("usage_x_pad"),
                                  (u / F.greatest(p, one)).alias("usage_over_pad"), (u < 100).alias("worn_in"), (u * u).alias("usage_sq"))


@query("standardise_by_fit_rows", sql("runs", """SELECT run_id, coalesce((usage - m)/(s + 1e-9), 0) AS usage, coalesce((film2 - fm)/(fs + 1e-9), 0) AS film FROM
  (SELECT *, CASE WHEN run_id % 5 <> 0 THEN film END AS film2 FROM runs), (SELECT avg(usage) AS m, stddev_pop(usage) AS s, avg(CASE WHEN run_id % 5 <> 0 THEN film END) AS fm,
   stddev_pop(CASE WHEN run_id % 5 <> 0 THEN film END) AS fs FROM runs WHERE is_ref)""", "run_id", "usage film"))
def _(spark, sf):
    from ..operators.ml import standardise
    df = runs(spark, sf).withColumn("film", F.when(F.col("run_id") % 5 != 0, F.col("film")))
    return standardise(df, ["usage", "film"], F.col("is_ref")).select("run_id", "usage", "film")


@query("clip_and_codes", sql("telemetry", """SELECT id, CASE WHEN s2 IS NOT NULL THEN least(greatest(s2, 10), 60) END AS s2c, coalesce(TRY_CAST(CASE WHEN id % 3 = 0 THEN 'x' ELSE CAST(runnum AS VARCHAR) END AS BIGINT), -1) AS code,
  round_even(s1/2.5, 0) AS key FROM telemetry""", "id", "s2c key", "code"))
def _(spark, sf):
    df = telemetry(spark, sf).withColumn("raw", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("runnum").cast("string")))
    return df.select("id", clip("s2", 10.0, 60.0).alias("s2c"), int_or_minus_one("raw").alias("code"), F.rint(F.col("s1") / 2.5).alias("key"))


@query("period_labels", sql("runs", """SELECT CASE WHEN t_end < 33500000 THEN 'warmup' WHEN t_end < 36000000 THEN 'dev' ELSE 'deploy' END AS period, count(*) AS n FROM runs WHERE y < 450 GROUP BY 1""", "period", "", "n"))
def _(spark, sf):
    p = F.when(F.col("t_end") < 33500000, "warmup").when(F.col("t_end") < 36000000, "dev").otherwise("deploy")
    return runs(spark, sf).filter("y < 450").groupBy(p.alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("fault_name_templates", sql("faults", "SELECT DISTINCT fault, 'ttf_' || fault AS label, split_part('ttf_' || fault, '_', 2) AS short FROM faults", "label short", "", "fault"))
def _(spark, sf):
    name = F.concat(F.lit("ttf_"), F.col("fault"))
    return faults(spark, sf).select("fault").dropDuplicates().select("fault", name.alias("label"), F.split_part(name, F.lit("_"), F.lit(2)).alias("short"))


@query("json_properties", sql("", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS INT)) AS k FROM events GROUP BY 1", "event_type", "", "k"))
def _(spark, sf):
    from .views import table
    x = F.from_json("props", "k int")
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(x["k"]).alias("k"))
