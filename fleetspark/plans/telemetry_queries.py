"""Telemetry: windows, labels, row features, baselines, sampling and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import (TTF_EDGES, all_far, any_near, best_action, interp, penalty_final, penalty_first, penalty_second,
                                 ttf_class)
from ..operators.baseline import curve_residual, global_stats, response_curve, step_stats, step_zscores
from ..operators.evaluate import (curve_summary, densest_window, downsample_max, lead_profile, risk, roc_points,
                                  score_curve, threshold_report)
from ..operators.events import excursions, operating_state, row_delta, stop_counts, time_to_next
from ..operators.ordered import key_rows
from ..operators.quantiles import weighted_quantile
from ..operators.rolling import rolling_event_count, rolling_stats
from ..operators.sampling import fault_matrix, fault_rates, thin, time_split, weighted_draw
from ..operators.scoring import (action_grid, cost_arrays, cost_matrix, decide, model_vs_null, tool_scores)
from ..operators.windows import training_table, window_labels, window_stats
from .registry import query
from .views import FAULTS, faults, scores, sql, telemetry

WINDOW = 86400.0
TREND = 5
TTFS = [f"ttf_{k}" for k in FAULTS]
ROLLS = {"5r": 5, "30r": 30}
GAP = 21600.0

# -- SQL fragments ------------------------------------------------------------------------------
STATS_SQL = """
  SELECT tool, CAST(floor(t / 86400) AS BIGINT) AS w, count(*) AS n_samples, max(t) AS t,
    avg(s1) AS s1_mean, stddev_samp(s1) AS s1_std, min(s1) AS s1_min, max(s1) AS s1_max, arg_max(s1, t) AS s1_last,
    avg(s2) AS s2_mean, stddev_samp(s2) AS s2_std, min(s2) AS s2_min, max(s2) AS s2_max, arg_max(s2, t) FILTER (s2 IS NOT NULL) AS s2_last
  FROM telemetry GROUP BY ALL"""
TREND_SQL = f"""
  SELECT *, w AS "window", s1_mean - avg(s1_mean) OVER p AS s1_trend, s2_mean - avg(s2_mean) OVER p AS s2_trend
  FROM ({STATS_SQL}) WINDOW p AS (PARTITION BY tool ORDER BY w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
TTF_SQL = "ttf AS (SELECT x.*, " + ", ".join(
    f"(SELECT min(f.t) FROM faults f WHERE f.tool = x.tool AND f.fault = {k} AND f.t >= x.t) - x.t AS ttf_{k}"
    for k in FAULTS) + " FROM telemetry x)"
LABELS_SQL = "labels_w AS (SELECT tool, CAST(floor(t / 86400) AS BIGINT) AS w, " + ", ".join(
    f"arg_max(ttf_{k}, t) FILTER (ttf_{k} IS NOT NULL) AS ttf_{k}" for k in FAULTS) + " FROM ttf GROUP BY ALL)"
STAT_NUMS = " ".join(f"{c}_{s}" for c in ("s1", "s2") for s in ("mean", "std", "min", "max", "last"))


def pen1(g, p):
    return (f"CASE WHEN {g} IS NULL AND {p} IS NULL THEN 0.0 WHEN {g} IS NULL THEN exp(-0.001*{p})*{p} "
            f"WHEN {p} IS NULL THEN exp(-0.001*{g})*{g} ELSE exp(-0.001*{g})*abs({g}-{p}) END")


def pen2(g, p):
    return (f"CASE WHEN {g} IS NULL AND {p} IS NULL THEN 0.0 WHEN {g} IS NULL THEN 5.0/(abs({p})+3) "
            f"WHEN {p} IS NULL THEN 20*exp(-1.0/(abs({g})+0.1)) ELSE 0.1*({g}-{p})*({g}-{p}) END")


def penf(g, p):
    return f"(({pen1(g, p)}) + ({pen2(g, p)})) / 2"


def cls_sql(g):
    whens = " ".join(f"WHEN {g} < {hi} THEN {i}" for i, hi in enumerate(TTF_EDGES[1:]))
    return f"CASE WHEN {g} IS NULL THEN 12 {whens} ELSE 12 END"


# -- shared Spark frames ------------------------------------------------------------------------
def tool_rows(spark, sf):
    return key_rows(telemetry(spark, sf), ["tool"])


def ttf(spark, sf, rows=None):
    rows = tool_rows(spark, sf) if rows is None else rows
    return time_to_next(telemetry(spark, sf), faults(spark, sf), ["tool"], "t", ["id"], "fault", FAULTS, rows=rows)


def labelled(spark, sf):
    features = window_stats(telemetry(spark, sf), ["tool"], "t", ["s1", "s2"], WINDOW, trend_windows=TREND)
    return training_table(features.drop("t"), window_labels(ttf(spark, sf), ["tool"], "t", TTFS, WINDOW), ["tool"])


def naive(df):
    """A naive numeric answer per fault: hours scale with the window mean; null when the last value is missing."""
    return df.withColumns({f"ans_{k}": F.when(F.col("s2_last").isNotNull(), F.col("s1_mean") * 100 * (k + 1)) for k in FAULTS})


NAIVE_SQL = "ans AS (SELECT j.*, " + ", ".join(
    f"CASE WHEN s2_last IS NOT NULL THEN s1_mean*100*{k + 1} END AS ans_{k}" for k in FAULTS) + \
    f" FROM (SELECT s.*, l.ttf_0, l.ttf_1, l.ttf_2 FROM ({STATS_SQL}) s JOIN labels_w l USING (tool, w)) j)"


# -- windows and labels -------------------------------------------------------------------------
@query("window_stats_with_trend", sql("telemetry", TREND_SQL, 'tool "window"', "t " + STAT_NUMS + " s1_trend s2_trend", "n_samples"))
def _(spark, sf):
    return window_stats(telemetry(spark, sf), ["tool"], "t", ["s1", "s2"], WINDOW, trend_windows=TREND)


@query("time_to_next_fault", sql("telemetry faults", f"+{TTF_SQL}, res AS (SELECT * FROM ttf)", "tool id", "t ttf_0 ttf_1 ttf_2"))
def _(spark, sf):
    return ttf(spark, sf).select("tool", "id", "t", *TTFS)


@query("window_labels", sql("telemetry faults", f'+{TTF_SQL}, {LABELS_SQL}, res AS (SELECT *, w AS "window" FROM labels_w)',
                            'tool "window"', "ttf_0 ttf_1 ttf_2"))
def _(spark, sf):
    return window_labels(ttf(spark, sf), ["tool"], "t", TTFS, WINDOW)


@query("features_join_labels", sql("telemetry faults", f"""+{TTF_SQL}, {LABELS_SQL},
  res AS (SELECT s.*, w AS "window", l.ttf_0, l.ttf_1, l.ttf_2 FROM ({STATS_SQL}) s JOIN labels_w l USING (tool, w))""",
                                   'tool "window"', "s1_mean s2_last ttf_0 ttf_1 ttf_2", "n_samples"))
def _(spark, sf):
    return labelled(spark, sf).select("tool", "window", "s1_mean", "s2_last", *TTFS, "n_samples")


@query("naive_answer_score", sql("telemetry faults", f"""+{TTF_SQL}, {LABELS_SQL}, {NAIVE_SQL},
  res AS (SELECT tool, count(*) AS n, """ + ", ".join(
    f"avg(({' + '.join(fn(f'ttf_{k}', f'ans_{k}') for k in FAULTS)}) / 3) AS {n}"
    for n, fn in (("s1", pen1), ("s2", pen2), ("final", penf))) + " FROM ans GROUP BY tool)", "tool", "s1 s2:0 final:0", "n"))
def _(spark, sf):
    df = naive(labelled(spark, sf))
    mean = lambda fn: F.avg(sum((fn(f"ttf_{k}", f"ans_{k}") for k in FAULTS), F.lit(0.0)) / 3)
    return df.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), mean(penalty_first).alias("s1"),
                                  mean(penalty_second).alias("s2"), mean(penalty_final).alias("final"))


@query("unweighted_tool_score", sql("telemetry faults", f"""+{TTF_SQL}, {LABELS_SQL}, {NAIVE_SQL},
  per AS (SELECT tool, sum({' + '.join(penf(f'ttf_{k}', f'ans_{k}') for k in FAULTS)}) / (count(*) * 3) AS score FROM ans GROUP BY tool),
  res AS (SELECT sum(score) AS total, count(*) AS tools FROM per)""", "", "total", "tools"))
def _(spark, sf):
    per = tool_scores(naive(labelled(spark, sf)), ["tool"], [penalty_final(f"ttf_{k}", f"ans_{k}") for k in FAULTS])
    return per.agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("tools"))


@query("answers_vs_all_null", sql("telemetry faults", f"""+{TTF_SQL}, {LABELS_SQL}, {NAIVE_SQL},
  per AS (SELECT tool, """ + ", ".join(
    f"sum(n_samples*({' + '.join(fn(f'ttf_{k}', a.format(k)) for k in FAULTS)})) / (sum(n_samples)*3) AS {n}_{tag}"
    for n, fn in (("S1", pen1), ("S2", pen2), ("final", penf))
    for tag, a in (("model", "ans_{}"), ("null", "CAST(NULL AS DOUBLE)"))) + """ FROM ans GROUP BY tool),
  res AS (SELECT 'S1' AS penalty, sum(S1_model) AS model, sum(S1_null) AS all_null FROM per
   UNION ALL SELECT 'S2', sum(S2_model), sum(S2_null) FROM per UNION ALL SELECT 'final', sum(final_model), sum(final_null) FROM per)""",
                                  "penalty", "model:0 all_null:0"))
def _(spark, sf):
    df = naive(labelled(spark, sf)).withColumn("n_samples", F.col("n_samples").cast("double"))
    return model_vs_null(df, ["tool"], [(f"ttf_{k}", f"ans_{k}") for k in FAULTS], "n_samples")


@query("penalties", sql("telemetry faults", f"""+{TTF_SQL}, res AS (SELECT tool, id, {pen1('ttf_0', 'ttf_1')} AS p1,
  {pen2('ttf_0', 'ttf_1')} AS p2, {penf('ttf_0', 'ttf_1')} AS pf, {cls_sql('ttf_0')} AS cls FROM ttf)""",
                        "tool id", "p1 p2:0 pf:0", "cls"))
def _(spark, sf):
    return ttf(spark, sf).select("tool", "id", penalty_first("ttf_0", "ttf_1").alias("p1"),
                                 penalty_second("ttf_0", "ttf_1").alias("p2"), penalty_final("ttf_0", "ttf_1").alias("pf"),
                                 ttf_class("ttf_0").alias("cls"))


@query("near_and_normal_rows", sql("telemetry faults", f"""+{TTF_SQL}, res AS (SELECT tool,
  count(*) FILTER (coalesce(ttf_0, 'inf') < 86400 OR coalesce(ttf_1, 'inf') < 86400 OR coalesce(ttf_2, 'inf') < 86400) AS near,
  count(*) FILTER (coalesce(ttf_0, 'inf') >= 50000 AND coalesce(ttf_1, 'inf') >= 50000 AND coalesce(ttf_2, 'inf') >= 50000) AS normal
  FROM ttf GROUP BY tool)""", "tool", "", "near normal"))
def _(spark, sf):
    return ttf(spark, sf).groupBy("tool").agg(F.count(F.when(any_near(TTFS, 86400), 1)).alias("near"),
                                              F.count(F.when(all_far(TTFS), 1)).alias("normal"))


# -- row features -------------------------------------------------------------------------------
W = "WINDOW w AS (PARTITION BY tool ORDER BY t, id)"
STATE_SQL = f"""st0 AS (SELECT *, coalesce(t - lag(t) OVER w, 0) AS dt,
    coalesce(recipe <> lag(recipe) OVER w, true) AS ch_recipe, coalesce(runnum <> lag(runnum) OVER w, true) AS ch_runnum
    FROM telemetry {W}),
  st AS (SELECT *, coalesce(t - max(CASE WHEN dt > 21600 THEN t END) OVER w, 1e7) AS since_gap,
    coalesce(t - max(CASE WHEN dt > 43200 THEN t END) OVER w, 1e7) AS since_stop,
    coalesce(t - max(CASE WHEN ch_recipe THEN t END) OVER w, 1e7) AS since_recipe_change,
    coalesce(t - max(CASE WHEN ch_runnum THEN t END) OVER w, 1e7) AS since_runnum_change FROM st0 {W})"""


@query("row_delta", sql("telemetry", f"""SELECT tool, id, least(greatest(coalesce(t - lag(t) OVER w, 0), 0), 3600) AS dt
  FROM telemetry {W}""", "tool id", "dt"))
def _(spark, sf):
    return row_delta(telemetry(spark, sf), ["tool"], "t", ["id"], cap=3600).select("tool", "id", "dt")


def state(spark, sf):
    return operating_state(telemetry(spark, sf), ["tool"], "t", ["id"], ["recipe", "runnum"],
                           {"gap": GAP, "stop": 2 * GAP})


@query("since_gap_stop_and_change", sql("telemetry", f"+{STATE_SQL}, res AS (SELECT * FROM st)", "tool id",
                                        "dt since_gap since_stop since_recipe_change since_runnum_change"))
def _(spark, sf):
    return state(spark, sf).select("tool", "id", "dt", "since_gap", "since_stop", "since_recipe_change", "since_runnum_change")


@query("stop_counts", sql("telemetry", f"""+{STATE_SQL}, res AS (SELECT tool, id,
  sum((dt > 21600)::INT) OVER r AS n_stop_6h_window, sum((dt > 43200)::INT) OVER r AS n_stop_12h_window FROM st0
  WINDOW r AS (PARTITION BY tool ORDER BY t, id ROWS 29 PRECEDING))""", "tool id", "", "n_stop_6h_window n_stop_12h_window"))
def _(spark, sf):
    df = row_delta(telemetry(spark, sf), ["tool"], "t", ["id"])
    out = stop_counts(df, ["tool"], "t", ["id"], {"6h": GAP, "12h": 2 * GAP}, 30)
    return out.select("tool", "id", "n_stop_6h_window", "n_stop_12h_window")


def roll_sql(cols, rolls, stats):
    made = {"mean": "avg({c}) OVER {w}", "std": "stddev_samp({c}) OVER {w}", "min": "min({c}) OVER {w}",
            "max": "max({c}) OVER {w}", "dev": "{c} - avg({c}) OVER {w}"}
    items = [made[s].format(c=c, w=f"w{n}") + f" AS {c}_{s}_{n}" for c in cols for n in rolls for s in stats]
    win = ", ".join(f"w{n} AS (PARTITION BY tool ORDER BY t, id ROWS {r - 1} PRECEDING)" for n, r in rolls.items())
    return items, win


ROLL_STATS = ("mean", "std", "min", "max", "dev")
_items, _win = roll_sql(["s1", "s2"], ROLLS, ROLL_STATS)


@query("rolling_stats", sql("telemetry", f"SELECT tool, id, {', '.join(_items)} FROM telemetry WINDOW {_win}", "tool id",
                            " ".join(f"{c}_{s}_{n}" for c in ("s1", "s2") for n in ROLLS for s in ROLL_STATS)))
def _(spark, sf):
    specs = [(c, n, w) for c in ("s1", "s2") for n, w in ROLLS.items()]
    out = rolling_stats(telemetry(spark, sf), ["tool"], "t", ["id"], specs, ROLL_STATS)
    return out.select("tool", "id", *[f"{c}_{s}_{n}" for c, n, _ in specs for s in ROLL_STATS])


@query("rolling_stats_wide", sql("telemetry", """SELECT recipe, id, avg(s1) OVER w AS s1_mean_long, stddev_samp(s1) OVER w AS s1_std_long,
  min(s1) OVER w AS s1_min_long, max(s1) OVER w AS s1_max_long FROM telemetry
  WINDOW w AS (PARTITION BY recipe ORDER BY t, id ROWS 449 PRECEDING)""", "recipe id", "s1_mean_long s1_std_long s1_min_long s1_max_long"))
def _(spark, sf):
    out = rolling_stats(telemetry(spark, sf), ["recipe"], "t", ["id"], [("s1", "long", 450)], ("mean", "std", "min", "max"))
    return out.select("recipe", "id", "s1_mean_long", "s1_std_long", "s1_min_long", "s1_max_long")


@query("rolling_event_count", sql("telemetry", """SELECT tool, id, sum((recipe = 'error')::INT) OVER a AS n_err_15r,
  sum((recipe = 'error')::INT) OVER b AS n_err_90r FROM telemetry WINDOW a AS (PARTITION BY tool ORDER BY t, id ROWS 14 PRECEDING),
  b AS (PARTITION BY tool ORDER BY t, id ROWS 89 PRECEDING)""", "tool id", "", "n_err_15r n_err_90r"))
def _(spark, sf):
    df = telemetry(spark, sf).withColumn("e", F.col("recipe") == "error")
    return rolling_event_count(df, ["tool"], "t", ["id"], {"err": "e"}, {"15r": 15, "90r": 90}).select(
        "tool", "id", "n_err_15r", "n_err_90r")


# -- baselines ----------------------------------------------------------------------------------
GLOBAL_SQL = "g AS (SELECT tool, " + ", ".join(
    f"median({c}) AS {c}_gmed, greatest(stddev_samp({c}), 1e-3) AS {c}_gscale, greatest(0.1*stddev_samp({c}), 1e-3) AS {c}_floor"
    for c in ("s1", "s2")) + " FROM fit GROUP BY tool)"
STEP_SQL = "st AS (SELECT fit.tool, recipe, recipe_step, " + ", ".join(
    f"median({c}) AS {c}_med, greatest((quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))/1.349, any_value({c}_floor)) AS {c}_scale"
    for c in ("s1", "s2")) + " FROM fit JOIN g USING (tool) GROUP BY ALL)"
SPLIT_SQL = "b AS (SELECT tool, quantile_cont(t, 0.75) AS boundary FROM telemetry GROUP BY tool), fit AS (SELECT x.* FROM telemetry x JOIN b USING (tool) WHERE t < boundary)"
Z_SQL = "z AS (SELECT x.*, " + ", ".join(f"({c} - coalesce({c}_med, {c}_gmed)) / coalesce({c}_scale, {c}_gscale) AS {c}_z"
                                       for c in ("s1", "s2")) + \
    " FROM telemetry x LEFT JOIN st ON x.tool = st.tool AND x.recipe = st.recipe AND x.recipe_step = st.recipe_step LEFT JOIN g ON x.tool = g.tool)"
STEP = ["recipe", "recipe_step"]


def fit_rows(spark, sf, rows):
    return time_split(telemetry(spark, sf), ["tool"], "t", rows=rows).filter(~F.col("is_val"))


@query("step_baseline", sql("telemetry", f"+{SPLIT_SQL}, {GLOBAL_SQL}, {STEP_SQL}, res AS (SELECT * FROM st)",
                            "tool recipe", "s1_med s1_scale s2_med s2_scale", "recipe_step"))
def _(spark, sf):
    rows = tool_rows(spark, sf)
    return step_stats(fit_rows(spark, sf, rows), ["tool"], STEP, ["s1", "s2"], rows)


@query("global_baseline", sql("telemetry", f"+{SPLIT_SQL}, {GLOBAL_SQL}, res AS (SELECT * FROM g)", "tool",
                              " ".join(f"{c}_{s}" for c in ("s1", "s2") for s in ("gmed", "gscale", "floor"))))
def _(spark, sf):
    rows = tool_rows(spark, sf)
    return global_stats(fit_rows(spark, sf, rows), ["tool"], ["s1", "s2"], rows)


def zscored(spark, sf, rows):
    return step_zscores(telemetry(spark, sf), fit_rows(spark, sf, rows), ["tool"], STEP, ["s1", "s2"], rows)


@query("step_zscores", sql("telemetry", f"+{SPLIT_SQL}, {GLOBAL_SQL}, {STEP_SQL}, {Z_SQL}, res AS (SELECT * FROM z)",
                           "tool id", "s1_z s2_z"))
def _(spark, sf):
    return zscored(spark, sf, tool_rows(spark, sf)).select("tool", "id", "s1_z", "s2_z")


_zitems, _zwin = roll_sql(["s1_z", "s2_z"], ROLLS, ("mean", "min", "max"))


@query("rolling_zscores", sql("telemetry", f"""+{SPLIT_SQL}, {GLOBAL_SQL}, {STEP_SQL}, {Z_SQL},
  res AS (SELECT tool, id, {', '.join(_zitems)} FROM z WINDOW {_zwin})""", "tool id",
                              " ".join(f"{c}_{s}_{n}" for c in ("s1_z", "s2_z") for n in ROLLS for s in ("mean", "min", "max"))))
def _(spark, sf):
    specs = [(c, n, w) for c in ("s1_z", "s2_z") for n, w in ROLLS.items()]
    rows = tool_rows(spark, sf)
    out = rolling_stats(zscored(spark, sf, rows), ["tool"], "t", ["id"], specs, ("mean", "min", "max"), rows)
    return out.select("tool", "id", *[f"{c}_{s}_{n}" for c, n, _ in specs for s in ("mean", "min", "max")])


EXC = [f"{p}_{d}" for p in ("p", "f") for d in ("low", "high")]


@query("excursion_events", sql("telemetry", f"""+{SPLIT_SQL}, {GLOBAL_SQL}, {STEP_SQL}, {Z_SQL},
  m AS (SELECT *, avg(s1_z) OVER r AS mp, avg(s2_z) OVER r AS mf FROM z WINDOW r AS (PARTITION BY tool ORDER BY t, id ROWS 2 PRECEDING)),
  e AS (SELECT *, coalesce(mp < -0.8, false) AS p_low, coalesce(mp > 0.8, false) AS p_high, coalesce(mf < -0.8, false) AS f_low,
    coalesce(mf > 0.8, false) AS f_high FROM m),
  res AS (SELECT tool, id, """ + ", ".join(
    f"coalesce(t - max(CASE WHEN {n} THEN t END) OVER w, 1e7) AS since_{n}, sum({n}::INT) OVER a AS n_{n}_20r" for n in EXC) +
    f" FROM e {W}, a AS (PARTITION BY tool ORDER BY t, id ROWS 19 PRECEDING))", "tool id",
    " ".join(f"since_{n}" for n in EXC), " ".join(f"n_{n}_20r" for n in EXC)))
def _(spark, sf):
    rows = tool_rows(spark, sf)
    out = excursions(zscored(spark, sf, rows), ["tool"], "t", ["id"], {"p": "s1_z", "f": "s2_z"}, 3, 0.8, {"20r": 20}, rows)
    return out.select("tool", "id", *[f"since_{n}" for n in EXC], *[f"n_{n}_20r" for n in EXC])


def curve_sql(n=10):
    qs = ", ".join(str(i / n) for i in range(n + 1))
    return f"""ok AS (SELECT recipe, id, tool, t, s2, s1 FROM telemetry WHERE s1 IS NOT NULL AND s2 IS NOT NULL),
  ed AS (SELECT recipe, list_sort(list_distinct(quantile_cont(s2, [{qs}]))) AS e FROM ok GROUP BY recipe),
  cv AS (SELECT recipe, bin, median(s2) AS s2_med, median(s1) AS s1_med FROM (
    SELECT ok.*, least(greatest(len(list_filter(e, lambda v: v <= s2)) - 1, 0), greatest(len(e) - 2, 0)) AS bin FROM ok JOIN ed USING (recipe))
    GROUP BY recipe, bin)"""


@query("response_curve", sql("telemetry", f"+{curve_sql()}, res AS (SELECT * FROM cv)", "recipe", "s2_med s1_med", "bin"))
def _(spark, sf):
    return response_curve(telemetry(spark, sf), ["recipe"], "s2", "s1", 10)


RESID_SQL = """pts AS (SELECT recipe, s2_med AS x0, s1_med AS y0, lead(s2_med) OVER c AS x1, lead(s1_med) OVER c AS y1,
    lag(s2_med) OVER c IS NULL AS is_first FROM cv WINDOW c AS (PARTITION BY recipe ORDER BY s2_med)),
  rs AS (SELECT x.*, s1 - CASE WHEN p.recipe IS NULL THEN (SELECT y0 FROM pts q WHERE q.recipe = x.recipe AND is_first)
      WHEN p.x1 IS NULL THEN p.y0 ELSE p.y0 + (p.y1 - p.y0) * (x.s2 - p.x0) / (p.x1 - p.x0) END AS resid
    FROM (SELECT * FROM telemetry WHERE s2 IS NOT NULL) x ASOF LEFT JOIN pts p ON x.recipe = p.recipe AND x.s2 >= p.x0
    UNION ALL SELECT *, NULL FROM telemetry WHERE s2 IS NULL)"""
_ritems, _rwin = roll_sql(["resid"], ROLLS, ("mean", "min", "max"))


def residuals(spark, sf):
    tel = telemetry(spark, sf)
    return curve_residual(tel, response_curve(tel, ["recipe"], "s2", "s1", 10), ["recipe"], "s2", "s1")


@query("rolling_curve_residual", sql("telemetry", f"+{curve_sql()}, {RESID_SQL}, res AS (SELECT tool, id, resid, {', '.join(_ritems)} FROM rs WINDOW {_rwin})",
                                     "tool id", "resid " + " ".join(f"resid_{s}_{n}" for n in ROLLS for s in ("mean", "min", "max"))))
def _(spark, sf):
    out = rolling_stats(residuals(spark, sf), ["tool"], "t", ["id"], [("resid", n, w) for n, w in ROLLS.items()],
                        ("mean", "min", "max"), tool_rows(spark, sf))
    return out.select("tool", "id", "resid", *[f"resid_{s}_{n}" for n in ROLLS for s in ("mean", "min", "max")])


@query("pressure_minus_flow", sql("telemetry", "SELECT tool, id, s1 - s2 AS diff FROM telemetry", "tool id", "diff"))
def _(spark, sf):
    return telemetry(spark, sf).select("tool", "id", (F.col("s1") - F.col("s2")).alias("diff"))


# -- sampling -----------------------------------------------------------------------------------
@query("time_split", sql("telemetry", """SELECT tool, id, t >= boundary AS is_val, boundary FROM telemetry JOIN
  (SELECT tool, quantile_cont(t, 0.75) AS boundary FROM telemetry GROUP BY tool) USING (tool)""", "tool id is_val", "boundary"))
def _(spark, sf):
    return time_split(telemetry(spark, sf), ["tool"], "t").select("tool", "id", "is_val", "boundary")


SAMPLE_SQL = f"""{TTF_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY t, id) - 1 AS pos,
    coalesce(ttf_0 < 10800, false) OR coalesce(ttf_1 < 10800, false) OR coalesce(ttf_2 < 10800, false) AS near FROM ttf),
  smp AS (SELECT *, CASE WHEN near THEN 2.0 ELSE 1/0.1 END AS weight FROM n WHERE (near AND pos % 2 = 0) OR
    (NOT near AND CAST('0x' || substr(md5(concat_ws('_', id, 'far')), 1, 8) AS BIGINT) / 4294967296.0 < 0.1))"""


def sample(spark, sf):
    rows = tool_rows(spark, sf)
    return thin(ttf(spark, sf, rows), ["tool"], "t", ["id"], TTFS, ["id"], 2, 0.1, rows=rows)


@query("weighted_thinning", sql("telemetry faults", f"+{SAMPLE_SQL}, res AS (SELECT * FROM smp)", "tool id", "weight ttf_0 ttf_1 ttf_2"))
def _(spark, sf):
    return sample(spark, sf).select("tool", "id", "weight", *TTFS)


@query("features_on_kept_rows", sql("telemetry faults", f"""+{SAMPLE_SQL},
  res AS (SELECT smp.tool, smp.id, r.m FROM smp JOIN (SELECT id, avg(s1) OVER (PARTITION BY tool ORDER BY t, id ROWS 29 PRECEDING) AS m
  FROM telemetry) r ON r.id = smp.id)""", "tool id", "m"))
def _(spark, sf):
    rows = tool_rows(spark, sf)
    rolled = rolling_stats(ttf(spark, sf, rows), ["tool"], "t", ["id"], [("s1", "30r", 30)], ("mean",), rows)
    return thin(rolled, ["tool"], "t", ["id"], TTFS, ["id"], 2, 0.1, rows=rows).select("tool", "id", F.col("s1_mean_30r").alias("m"))


@query("fault_rates", sql("telemetry faults", """+b AS (SELECT tool, quantile_cont(t, 0.75) AS boundary FROM telemetry GROUP BY tool),
  d AS (SELECT DISTINCT tool, t, fault FROM faults JOIN b USING (tool) WHERE t < boundary),
  res AS (SELECT tool, """ + ", ".join(f"count(*) FILTER (fault = {k}) / greatest((max(t)-min(t))/86400, 1) AS rate_{k}" for k in FAULTS) +
                        " FROM d GROUP BY tool)", "tool", "rate_0 rate_1 rate_2"))
def _(spark, sf):
    bound = time_split(telemetry(spark, sf), ["tool"], "t").groupBy("tool").agg(F.max("boundary").alias("boundary"))
    return fault_rates(faults(spark, sf), ["tool"], "t", "fault", FAULTS, bound)


@query("fault_matrix", sql("faults", "SELECT tool, " + ", ".join(f"count(DISTINCT t) FILTER (fault = {k}) AS fault_{k}" for k in FAULTS) +
                           " FROM faults GROUP BY tool", "tool", "", "fault_0 fault_1 fault_2"))
def _(spark, sf):
    return fault_matrix(faults(spark, sf), ["tool"], "t", "fault", FAULTS)


@query("distinct_faults", sql("faults", "SELECT DISTINCT tool, t, fault FROM faults", "tool", "t", "fault"))
def _(spark, sf):
    return faults(spark, sf).dropDuplicates(["tool", "t", "fault"]).select("tool", "t", "fault")


@query("weighted_draw", sql("telemetry", """+u AS (SELECT *, ln(greatest(CAST('0x' || substr(md5(concat_ws('_', id, 'pick')), 1, 8) AS BIGINT) / 4294967296.0, 1e-12))
   / (runnum + 1.0) AS u FROM telemetry),
  res AS (SELECT recipe, id FROM u QUALIFY row_number() OVER (PARTITION BY recipe ORDER BY u DESC, id DESC) <= 100)""", "recipe id"))
def _(spark, sf):
    df = telemetry(spark, sf).withColumn("w", F.col("runnum") + 1.0)
    return weighted_draw(df, ["recipe"], "w", ["id"], 100).select("recipe", "id")


# -- costs and decisions ------------------------------------------------------------------------
ACTIONS_SQL = "acts AS (SELECT a, CASE WHEN a > 0 THEN (a - 1) * 20.0 END AS action FROM range(0, 362) r(a))"
COST_SQL = f"""{ACTIONS_SQL}, cost AS (SELECT cls, a, any_value(action) AS action, sum(weight * {penf('ttf_0', 'action')}) / sum(weight) AS cost
  FROM (SELECT *, {cls_sql('ttf_0')} AS cls FROM smp), acts GROUP BY cls, a)"""


@query("cost_matrix", sql("telemetry faults", f"+{SAMPLE_SQL}, {COST_SQL}, res AS (SELECT * FROM cost)", "", "action cost:0", "cls a"))
def _(spark, sf):
    return cost_matrix(sample(spark, sf), "ttf_0", "weight", action_grid())


def proba_col():
    """A deterministic 13-class distribution from the row's sensors (stands in for a fitted model's output)."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.lit(1.0) + (F.coalesce(F.col("runnum"), F.lit(0)) * (k + 1) + k) % 7)
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raw, lambda v: v / total)


PROBA_SQL = """pr AS (SELECT *, list_transform(raw, lambda v: v / list_sum(raw)) AS proba FROM
  (SELECT *, list_transform(range(0, 13), lambda k: 1.0::DOUBLE + (runnum * (k + 1) + k) % 7) AS raw FROM telemetry))"""


@query("decide_answers", sql("telemetry faults", f"""+{SAMPLE_SQL}, {COST_SQL}, {PROBA_SQL},
  ex AS (SELECT pr.id, a, any_value(action) AS action, sum(coalesce(proba[cls + 1], 0) * cost) AS e FROM pr, cost GROUP BY pr.id, a),
  res AS (SELECT id, any_value(action) FILTER (rk = 1) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(e, 9), a) AS rk FROM ex)
  GROUP BY id)""", "id", "answer"))
def _(spark, sf):
    costs = cost_matrix(sample(spark, sf), "ttf_0", "weight", action_grid())
    rows = telemetry(spark, sf).select("id", proba_col().alias("proba"))
    return decide(rows, "proba", cost_arrays(costs, 13)).select("id", "answer")


@query("decide_with_array_functions", sql("telemetry", """+c AS (SELECT * FROM (VALUES (0, 5.0::DOUBLE, 9.0::DOUBLE, 4.0::DOUBLE), (1, 7.0, 2.0, 6.0), (2, 1.0, 8.0, 3.0)) v(k, a, b, c)),
  p AS (SELECT id, runnum/12.0::DOUBLE AS p0, (11 - runnum)/24.0::DOUBLE AS p1 FROM telemetry),
  e AS (SELECT id, p0*5 + p1*7 + (1-p0-p1)*1 AS a, p0*9 + p1*2 + (1-p0-p1)*8 AS b, p0*4 + p1*6 + (1-p0-p1)*3 AS c FROM p),
  res AS (SELECT id, CASE WHEN a <= b AND a <= c THEN NULL WHEN b <= c THEN 10.0 ELSE 20.0 END AS answer FROM e)""", "id", "answer"))
def _(spark, sf):
    arr = lambda vs: F.array(*[F.lit(v) if v is None else F.lit(float(v)) for v in vs])
    p0, p1 = F.col("runnum") / F.lit(12.0), (11 - F.col("runnum")) / F.lit(24.0)
    costs = F.array(arr([5, 9, 4]), arr([7, 2, 6]), arr([1, 8, 3]))
    return telemetry(spark, sf).select("id", best_action(F.array(p0, p1, 1 - p0 - p1), costs, arr([None, 10, 20])).alias("answer"))


@query("near_risk", sql("telemetry", f"+{PROBA_SQL}, res AS (SELECT id, list_sum(proba[1:9]) AS risk FROM pr)", "id", "risk"))
def _(spark, sf):
    return telemetry(spark, sf).select("id", risk(proba_col()).alias("risk"))


# -- detection ----------------------------------------------------------------------------------
CURVE_SQL = """per AS (SELECT lang, score, sum(CASE WHEN pos THEN w ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS n FROM scores GROUP BY ALL),
  cu AS (SELECT *, sum(p) OVER c AS tp, sum(n) OVER c AS fp, sum(p) OVER t AS tot_p, sum(n) OVER t AS tot_n FROM per
    WINDOW c AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY lang))"""


@query("roc_auc_and_average_precision", sql("scores", f"""+{CURVE_SQL}, res AS (SELECT lang, sum(n*(tp+tp-p)/2)/nullif(max(tot_p)*max(tot_n), 0) AS auc,
  sum(CASE WHEN p > 0 THEN p*tp/(tp+fp) ELSE 0 END)/nullif(max(tot_p), 0) AS ap, max(tot_p)/(max(tot_p)+max(tot_n)) AS base_rate FROM cu GROUP BY lang)""", "lang", "auc ap base_rate"))
def _(spark, sf):
    return curve_summary(score_curve(scores(spark, sf), ["lang"], "pos", "score", "w"), ["lang"])


@query("roc_curve_points", sql("scores", f"""+{CURVE_SQL}, res AS (SELECT lang, fp/nullif(tot_n, 0) AS fpr, tp/nullif(tot_p, 0) AS tpr FROM cu
  WHERE floor(fp/nullif(tot_n, 0)*19) > floor((fp-n)/nullif(tot_n, 0)*19) OR (fp = tot_n AND tp = tot_p))""", "lang", "fpr tpr"))
def _(spark, sf):
    return roc_points(score_curve(scores(spark, sf), ["lang"], "pos", "score", "w"), ["lang"], 20)


@query("weighted_quantile", sql("scores", """+c AS (SELECT lang, score, sum(w) OVER (PARTITION BY lang ORDER BY score) AS cw, sum(w) OVER (PARTITION BY lang) AS tw FROM scores),
  res AS (SELECT lang, min(score) AS wq FROM c WHERE cw >= 0.9 * tw GROUP BY lang)""", "lang", "wq"))
def _(spark, sf):
    return weighted_quantile(scores(spark, sf), ["lang"], "score", "w", 0.9)


LEADS = [0, 3600, 7200, 10800]


@query("threshold_at_false_alarm_rate", sql("telemetry faults", f"""+{TTF_SQL}, x AS (SELECT *, coalesce(ttf_1, 'inf') AS g, runnum + 1.0 AS w FROM ttf),
  cw AS (SELECT recipe, s1, sum(w) OVER (PARTITION BY recipe ORDER BY s1) AS c, sum(w) OVER (PARTITION BY recipe) AS tw FROM x WHERE g >= 10800),
  th AS (SELECT recipe, min(s1) AS threshold FROM cw WHERE c >= (1 - 0.05) * tw GROUP BY recipe),
  y AS (SELECT *, (s1 >= threshold)::INT AS o FROM x JOIN th USING (recipe)),
  res AS (SELECT recipe, max(threshold) AS threshold, sum(w*o) FILTER (g < 3600) / sum(w) FILTER (g < 3600) AS recall, """ + ", ".join(
    f"sum(w*o) FILTER (g >= {a} AND g < {b}) / sum(w) FILTER (g >= {a} AND g < {b}) AS recall_{a}_{b}" for a, b in zip(LEADS, LEADS[1:])) +
    " FROM y GROUP BY recipe)", "recipe", "threshold recall recall_0_3600 recall_3600_7200 recall_7200_10800"))
def _(spark, sf):
    df = ttf(spark, sf).withColumn("w", F.col("runnum") + 1.0)
    return threshold_report(df, ["recipe"], "s1", "w", "ttf_1", 0.05, 3600, 10800, LEADS)


@query("lead_time_profile", sql("telemetry faults", f"""+{TTF_SQL}, x AS (SELECT *, runnum + 1.0 AS w FROM ttf),
  b AS (SELECT recipe, sum(w*s1) FILTER (s1 IS NOT NULL)/sum(w) FILTER (s1 IS NOT NULL) AS b1, sum(w*s2) FILTER (s2 IS NOT NULL)/sum(w) FILTER (s2 IS NOT NULL) AS b2
    FROM x WHERE ttf_0 IS NULL OR ttf_0 > 50000 GROUP BY recipe),
  res AS (SELECT recipe, CASE WHEN -ttf_0 < -7200 THEN 0 WHEN -ttf_0 < -3600 THEN 1 WHEN -ttf_0 < -1800 THEN 2 ELSE 3 END AS bin,
    avg(s1 - b1) AS s1_dev, avg(s2 - b2) AS s2_dev, count(*) AS n FROM x LEFT JOIN b USING (recipe) WHERE -ttf_0 >= -10800 AND -ttf_0 < 0 GROUP BY ALL)""",
                                "recipe", "s1_dev s2_dev", "bin n"))
def _(spark, sf):
    df = ttf(spark, sf).withColumn("w", F.col("runnum") + 1.0)
    return lead_profile(df, ["recipe"], "ttf_0", "w", ["s1", "s2"], [-10800, -7200, -3600, -1800, 0])


DENSE_SQL = """d AS (SELECT DISTINCT tool, fault, t FROM faults), bk AS (SELECT tool, fault FROM d GROUP BY ALL ORDER BY count(*) DESC, tool, fault LIMIT 1),
  m AS (SELECT d.* FROM d JOIN bk USING (tool, fault)),
  dw AS (SELECT a.tool, a.fault, a.t AS start, count(*) AS n FROM m a JOIN m b ON b.t >= a.t AND b.t < a.t + 172800 GROUP BY ALL ORDER BY n DESC, start LIMIT 1)"""


@query("densest_fault_window", sql("faults", f"+{DENSE_SQL}, res AS (SELECT * FROM dw)", "tool", "start", "fault n"))
def _(spark, sf):
    return densest_window(faults(spark, sf), ["tool", "fault"], "t", 48)


@query("risk_timeline", sql("telemetry faults", f"""+{DENSE_SQL}, {PROBA_SQL}, lim AS (SELECT tool, start - 21600 AS s FROM dw),
  res AS (SELECT pr.tool, CAST(floor((t - s) / (172800 / 40)) AS BIGINT) AS i, avg(t - s) AS t_mean, max(list_sum(proba[1:9])) AS risk_max
  FROM pr JOIN lim USING (tool) WHERE t >= s AND t < s + 172800 GROUP BY pr.tool, i)""", "tool i", "t_mean risk_max"))
def _(spark, sf):
    win = densest_window(faults(spark, sf), ["tool", "fault"], "t", 48).select("tool", (F.col("start") - 21600).alias("s"))
    df = telemetry(spark, sf).withColumn("risk", risk(proba_col())).join(F.broadcast(win), "tool")  # one row
    return downsample_max(df, ["tool"], "t", "risk", F.col("s"), F.col("s") + 172800, 40)


@query("piecewise_interpolation", sql("telemetry", """SELECT tool, id, CASE WHEN s1 <= 5 THEN 1.0 WHEN s1 >= 80 THEN -4.0
  WHEN s1 < 20 THEN 1 + 9 * (s1 - 5) / 15 ELSE 10 - 14 * (s1 - 20) / 60 END AS v FROM telemetry""", "tool id", "v"))
def _(spark, sf):
    arr = lambda vs: F.array(*[F.lit(float(v)) for v in vs])
    return telemetry(spark, sf).select("tool", "id", interp("s1", arr([5, 20, 80]), arr([1, 10, -4])).alias("v"))


@query("last_row_per_tool", sql("telemetry", """SELECT tool, arg_max(id, t) AS id, max(t) AS t, arg_max(s1, t) AS s1 FROM telemetry GROUP BY tool""",
                                "tool id", "t s1"))
def _(spark, sf):
    return telemetry(spark, sf).groupBy("tool").agg(F.max_by(F.struct("id", "t", "s1"), F.struct("t", "id")).alias("r")).select("tool", "r.*")
