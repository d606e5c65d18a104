"""Runs: annotation, summaries, shape features, resampling, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import shape as S
from ..operators.asof import range_counts
from ..operators.ordered import Ordered, join_keys, key_rows
from ..operators.rolling import rolling_stats
from .registry import query
from .views import SEQ, run_rows, runs, sql

C = R.RunColumns(seq=SEQ, zones=["head", "flow"], flows=["flow"], usage=["usage"])
CH = ["pressure", "head", "flow", "rot"]
ACTIVE = "pressure > 0 AND flow > 0"

ANN = """ann AS (SELECT r.*, g.grp, least(greatest(chamber - g.grp, 0), 2) AS step, pressure > 0 AND flow > 0 AS active
  FROM run_rows r JOIN (SELECT run_id, CASE WHEN min(chamber) <= 3 THEN 1 ELSE 4 END AS grp FROM run_rows GROUP BY run_id) g USING (run_id))"""
ORD = "ts, q1, q2, q3, q4"
DT = f"""{ANN}, d AS (SELECT *, least(greatest(coalesce(ts - lag(ts) OVER w, 0), 0), 5) AS dt, ts - lag(ts) OVER w AS gap
  FROM ann WINDOW w AS (PARTITION BY run_id ORDER BY {ORD}))"""


def annotated(spark, sf):
    return R.annotate(run_rows(spark, sf), C, "chamber", F.expr(ACTIVE))


def bound(spark, sf):
    return key_rows(run_rows(spark, sf), ["run_id"])


@query("annotated_run_rows", sql("run_rows", f"+{ANN}, res AS (SELECT run_id, grp, step, active, count(*) AS n, sum(pressure) AS p FROM ann GROUP BY ALL)",
                                 "active", "p", "run_id grp step n"))
def _(spark, sf):
    return annotated(spark, sf).groupBy("run_id", "grp", "step", "active").agg(F.count(F.lit(1)).alias("n"), F.sum("pressure").alias("p"))


_PV = [f"pv_{p}_{r}" for p in ("pressure", "head", "flow") for r in ("head", "rot")]


@query("run_summary_and_dose", sql("run_rows", f"""+{DT}, res AS (SELECT run_id, min(grp) AS grp, min(ts) AS t_start, max(ts) - min(ts) AS duration,
  count(*) AS n_rows, count(*) FILTER (active) AS active_sec, min(usage) AS usage_start, max(usage) - min(usage) AS usage_delta,
  """ + ", ".join(f"sum({p}*{r}*dt) AS pv_{p}_{r}" for p in ("pressure", "head", "flow") for r in ("head", "rot")) + " FROM d GROUP BY run_id)",
    "run_id", "t_start duration usage_start usage_delta " + " ".join(_PV), "grp n_rows active_sec"))
def _(spark, sf):
    return R.run_summary(annotated(spark, sf), C, bound(spark, sf))


@query("step_columns", sql("run_rows", f"+{ANN}, res AS (SELECT run_id, " + ", ".join(
    [f"avg({c}) FILTER (active AND step = {s}) AS {c}_s{s}_mean" for c in ("pressure", "flow") for s in (0, 1, 2)] +
    [f"stddev_samp(pressure) FILTER (active AND step = {s}) AS pressure_s{s}_std" for s in (0, 1, 2)] +
    [f"nullif(count(*) FILTER (active AND step = {s}), 0) AS active_sec_s{s}" for s in (0, 1, 2)]) + " FROM ann GROUP BY run_id)",
    "run_id", " ".join([f"{c}_s{s}_mean" for c in ("pressure", "flow") for s in (0, 1, 2)] + [f"pressure_s{s}_std" for s in (0, 1, 2)]),
    "active_sec_s0 active_sec_s1 active_sec_s2"))
def _(spark, sf):
    return R.step_columns(annotated(spark, sf), ["run_id"], ["pressure", "flow"], ["pressure"])


ZM, ZS = "((head + flow) / 2)", "sqrt(((head - (head+flow)/2)*(head - (head+flow)/2) + (flow - (head+flow)/2)*(flow - (head+flow)/2)) / 2)"
ROWS_OF = {"v_rel_mean": "abs(head - rot)", "v_sum_mean": "head + rot", "rot_on_mean": "(rot > 0)::INT::DOUBLE",
           "head_ratio": "head / greatest(pressure, 1e-3)", "flow_ratio": "flow / greatest(pressure, 1e-3)",
           "zone_cv": f"{ZS} / greatest({ZM}, 1e-3)", "sommerfeld": "(head + rot) * flow / greatest(pressure, 1e-3)",
           "water_frac_active": "dw", "p_all_mean": "pressure + head + flow"}
SUMS = {"v_rel_int": "abs(head-rot)*dt", "v_sum_int": "(head+rot)*dt", "pv_rel": "pressure*abs(head-rot)*dt", "pv_sum": "pressure*(head+rot)*dt",
        "pv_rot_int": "CASE WHEN rot > 0 THEN pressure*(head+rot)*dt ELSE 0 END", "rot_sec": "CASE WHEN rot > 0 THEN dt ELSE 0 END",
        "p_int": "pressure*dt", "flow_vol": "flow*dt", "pv_head": "pressure*head*dt"}
STEP_OF = {"v_rel": "abs(head - rot)", "zone_cv": ROWS_OF["zone_cv"], "sommerfeld": ROWS_OF["sommerfeld"]}
_phys = [f"avg({e}) FILTER (active) AS {n}" for n, e in ROWS_OF.items()] + [f"sum({e}) FILTER (active) AS {n}" for n, e in SUMS.items()] + \
    [f"avg({e}) FILTER (active AND step = {s}) AS {n}_s{s}" for n, e in STEP_OF.items() for s in (0, 1, 2)] + \
    [f"sum(pressure*dt) FILTER (active AND step = {s}) AS p_int_s{s}" for s in (0, 1, 2)] + \
    ["sum(flow*dt) AS flow_vol_all", "sum(flow*dt) FILTER (NOT active) AS flow_vol_idle", "avg(dw) AS water_frac_all",
     "avg(dw) FILTER (NOT active) AS water_frac_idle", "sum(dw*dt) AS water_sec", "min(ts) FILTER (active) - min(ts) AS lead_sec",
     "max(ts) - max(ts) FILTER (active) AS tail_sec", "stddev_samp(pressure) FILTER (active) / greatest(avg(pressure) FILTER (active), 1e-3) AS p_cv",
     "max(gap) AS gap_max", "sum(flow*dt) FILTER (active) / nullif(sum(dt) FILTER (active), 0) AS vol_per_sec",
     "sum(flow*dt) FILTER (active) / nullif(sum(pressure*head*dt) FILTER (active), 0) * 1e4 AS vol_per_pv"]
_phys_i = ["count(*) AS rows_all", "count(*) FILTER (pressure > 0 AND NOT active) AS pressed_idle_rows"] + [f"count(*) FILTER (step = {s}) AS rows_s{s}" for s in (0, 1, 2)]


@query("run_physics", sql("run_rows", f"+{DT}, res AS (SELECT run_id, {', '.join(_phys + _phys_i)} FROM d GROUP BY run_id)", "run_id",
                          " ".join(e.rsplit(" AS ", 1)[1] for e in _phys), " ".join(e.rsplit(" AS ", 1)[1] for e in _phys_i)))
def _(spark, sf):
    return R.physics(annotated(spark, sf), C, bound(spark, sf))


# -- shape --------------------------------------------------------------------------------------
X = f"""{ANN}, sg AS (SELECT run_id, step, min(ts) AS t0, max(ts) AS t1, count(*) AS n_all, count(*) FILTER (active) AS n_act FROM ann GROUP BY ALL),
  x AS (SELECT a.*, ts - t0 AS t, n_all, n_act, active OR n_act = 0 AS use FROM ann a JOIN sg USING (run_id, step)),
  x1 AS (SELECT *, lag(ts) OVER w IS NOT NULL AS has_prev, least(greatest(coalesce(ts - lag(ts) OVER w, 0), 0), 5) AS dt,
    lag(active) OVER w AS p_active, lag(dw) OVER w AS p_dw, count(*) FILTER (use) OVER w AS ord
    FROM x WINDOW w AS (PARTITION BY run_id, step ORDER BY {ORD}))"""
LONG = f"""{X}, lg AS (SELECT run_id, step, t, dt, use, ord, n_all, n_act, {ORD}, channel, v FROM x1 UNPIVOT (v FOR channel IN (pressure, head, flow, rot))),
  lp AS (SELECT *, lag(v) OVER w AS pv FROM lg WINDOW w AS (PARTITION BY run_id, step, channel ORDER BY {ORD})),
  lu AS (SELECT *, lag(v) OVER w AS pu FROM lg WHERE use WINDOW w AS (PARTITION BY run_id, step, channel ORDER BY {ORD})),
  pl AS (SELECT run_id, step, channel, median(v) AS plateau FROM lg WHERE use GROUP BY ALL)"""


def by_run(spark, sf):
    """Annotated rows and the answer of the size check, which keeps runs that fit in one slice in one task."""
    b = bound(spark, sf)
    return R.annotate(run_rows(spark, sf), C, "chamber", F.expr(ACTIVE), b), b


def stepped(spark, sf):
    rows, b = by_run(spark, sf)
    return S.step_rows(rows, C, CH, b), b


def long_rows(spark, sf):
    x, b = stepped(spark, sf)
    return S.long_channels(x, C, CH), b


def with_plateau(spark, sf):
    long, b = long_rows(spark, sf)
    return S.with_plateau(long, C, b), b


TIMING = "step_sec dt_mean active_frac pre_active_sec post_active_sec active_span_sec dw_frac dw_active_frac"


@query("shape_timing", sql("run_rows", f"""+{X}, res AS (SELECT run_id, step, max(t) AS step_sec, count(*) AS n_rows, avg(dt) FILTER (has_prev) AS dt_mean,
  avg(active::INT) AS active_frac, min(t) FILTER (active) AS pre_active_sec, max(t) - max(t) FILTER (active) AS post_active_sec,
  max(t) FILTER (active) - min(t) FILTER (active) AS active_span_sec,
  CASE WHEN count(*) FILTER (active) > 0 THEN (1 + count(*) FILTER (has_prev AND active <> p_active)) // 2 END AS active_gaps,
  avg((dw > 0)::INT) AS dw_frac, avg((dw > 0)::INT) FILTER (active) AS dw_active_frac, count(*) FILTER (has_prev AND dw <> p_dw) AS dw_toggles
  FROM x1 GROUP BY ALL)""", "run_id", TIMING, "step n_rows active_gaps dw_toggles"))
def _(spark, sf):
    return S.timing(stepped(spark, sf)[0], C)


LEVEL = "q05 q25 plateau q75 q95 pstd first last max min_active zero_frac integral iqr"


@query("shape_level", sql("run_rows", f"""+{LONG}, res AS (SELECT run_id, step, channel,
  quantile_cont(v, 0.05) FILTER (use) AS q05, quantile_cont(v, 0.25) FILTER (use) AS q25, median(v) FILTER (use) AS plateau,
  quantile_cont(v, 0.75) FILTER (use) AS q75, quantile_cont(v, 0.95) FILTER (use) AS q95, stddev_pop(v) FILTER (use) AS pstd,
  arg_min(v, ({ORD})) FILTER (use) AS "first", arg_max(v, ({ORD})) FILTER (use) AS "last", max(v) AS "max", min(v) FILTER (use) AS min_active,
  avg((v <= 0)::INT) AS zero_frac, sum(v*dt) AS integral, quantile_cont(v, 0.75) FILTER (use) - quantile_cont(v, 0.25) FILTER (use) AS iqr
  FROM lg GROUP BY ALL)""", "run_id channel", 'q05 q25 plateau q75 q95 pstd "first" "last" "max" min_active zero_frac integral iqr', "step"))
def _(spark, sf):
    long, b = long_rows(spark, sf)
    return S.level(long, C, b)


RAMP = "ramp_up ramp_down hi_sec hi_frac t_stable t_on t_off slope half_diff abs_diff_mean"
RAMP_SQL = f"""{LONG}, rp AS (SELECT lg.*, plateau, lu.pu FROM lg JOIN pl USING (run_id, step, channel)
    LEFT JOIN lu USING (run_id, step, channel, ts, q1, q2, q3, q4)),
  ramp AS (SELECT run_id, step, channel, min(t) FILTER (plateau > 0 AND v >= 0.9*plateau) AS ramp_up,
    max(t) - max(t) FILTER (plateau > 0 AND v >= 0.9*plateau) AS ramp_down,
    max(t) FILTER (plateau > 0 AND v >= 0.9*plateau) - min(t) FILTER (plateau > 0 AND v >= 0.9*plateau) AS hi_sec,
    CASE WHEN count(*) FILTER (plateau > 0 AND v >= 0.9*plateau) > 0 THEN avg((plateau > 0 AND v >= 0.9*plateau)::INT) END AS hi_frac,
    min(t) FILTER (plateau > 0 AND abs(v - plateau) <= 0.05*abs(plateau)) AS t_stable,
    min(t) FILTER (plateau > 0 AND v >= 0.5*plateau) AS t_on, max(t) FILTER (plateau > 0 AND v >= 0.5*plateau) AS t_off,
    CASE WHEN count(*) FILTER (use) >= 3 AND max(t) FILTER (use) > min(t) FILTER (use)
      THEN (regr_slope(v, t) FILTER (use)) * (max(t) FILTER (use) - min(t) FILTER (use)) END AS slope,
    CASE WHEN count(*) FILTER (use) >= 3 AND max(t) FILTER (use) > min(t) FILTER (use)
      THEN avg(v) FILTER (use AND ord > (CASE WHEN n_act > 0 THEN n_act ELSE n_all END)//2) - avg(v) FILTER (use AND ord <= (CASE WHEN n_act > 0 THEN n_act ELSE n_all END)//2) END AS half_diff,
    CASE WHEN count(*) FILTER (use) >= 2 THEN count(*) FILTER (use AND pu IS NOT NULL AND abs(v - pu) > 0.1*greatest(abs(plateau), 1e-6)) END AS n_jumps,
    avg(abs(v - pu)) FILTER (use) AS abs_diff_mean FROM rp GROUP BY ALL)"""


@query("shape_ramp_and_drift", sql("run_rows", f"+{RAMP_SQL}, res AS (SELECT * FROM ramp)", "run_id channel", RAMP, "step n_jumps"))
def _(spark, sf):
    return S.ramp_and_drift(with_plateau(spark, sf)[0], C)


@query("shape_channel_lags", sql("run_rows", f"""+{RAMP_SQL}, res AS (SELECT r.run_id, r.step, r.channel, r.t_on - b.t_on AS lag_on, r.t_off - b.t_off AS lag_off
  FROM ramp r LEFT JOIN (SELECT * FROM ramp WHERE channel = 'pressure') b USING (run_id, step) WHERE r.channel <> 'pressure')""",
                                 "run_id channel", "lag_on lag_off", "step"))
def _(spark, sf):
    return S.channel_lags(S.ramp_and_drift(with_plateau(spark, sf)[0], C), C, "pressure")


@query("shape_run_lengths", sql("run_rows", f"""+{LONG},
  fa AS (SELECT lp.*, (pv IS NOT NULL AND round_even(v/(greatest(abs(plateau), 1e-6)*0.02), 0) <> round_even(pv/(greatest(abs(plateau), 1e-6)*0.02), 0))::INT AS ch
    FROM lp JOIN pl USING (run_id, step, channel)),
  ia AS (SELECT *, sum(ch) OVER (PARTITION BY run_id, step, channel ORDER BY {ORD}) AS isl FROM fa),
  ka AS (SELECT run_id, step, channel, isl, count(*) AS k FROM ia GROUP BY ALL),
  a AS (SELECT run_id, step, channel, count(*) FILTER (k >= 3) AS n_levels, count(*) - 1 AS n_changes, max(k)/sum(k) AS longest_run FROM ka GROUP BY ALL),
  fu AS (SELECT lu.*, (pu IS NOT NULL AND round_even(v/(greatest(abs(plateau), 1e-6)*0.02), 0) <> round_even(pu/(greatest(abs(plateau), 1e-6)*0.02), 0))::INT AS ch
    FROM lu JOIN pl USING (run_id, step, channel)),
  iu AS (SELECT *, sum(ch) OVER (PARTITION BY run_id, step, channel ORDER BY {ORD}) AS isl FROM fu),
  u AS (SELECT run_id, step, channel, count(*) FILTER (k >= 3) AS n_levels_active FROM (SELECT run_id, step, channel, isl, count(*) AS k FROM iu GROUP BY ALL) GROUP BY ALL),
  res AS (SELECT * FROM a LEFT JOIN u USING (run_id, step, channel))""", "run_id channel", "longest_run", "step n_levels n_changes n_levels_active"))
def _(spark, sf):
    x, b = with_plateau(spark, sf)
    return S.run_lengths(x, C, b)


@query("shape_wide_table")
def _(spark, sf):
    rows, b = by_run(spark, sf)
    return S.shape_table(rows, C, CH, "pressure", b)


def resample_sql(p=16):
    return f"""{ANN}, ix AS (SELECT run_id, step, pressure, flow, row_number() OVER (PARTITION BY run_id, step ORDER BY {ORD}) - 1 AS i,
    count(*) OVER (PARTITION BY run_id, step) AS n FROM ann),
  gr AS (SELECT DISTINCT run_id, step, n, g, g*(n-1)/{p - 1}.0::DOUBLE AS pos FROM ix, range(0, {p}) r(g) WHERE n >= 2),
  rz AS (SELECT gr.run_id, gr.step, g AS grid, n_rows, a.pressure + (coalesce(b.pressure, a.pressure) - a.pressure)*(pos - floor(pos)) AS pressure,
    a.flow + (coalesce(b.flow, a.flow) - a.flow)*(pos - floor(pos)) AS flow
    FROM (SELECT *, n AS n_rows FROM gr) gr JOIN ix a ON a.run_id = gr.run_id AND a.step = gr.step AND a.i = floor(pos)
    LEFT JOIN ix b ON b.run_id = gr.run_id AND b.step = gr.step AND b.i = floor(pos) + 1)"""


@query("resampled_trajectories", sql("run_rows", f"+{resample_sql()}, res AS (SELECT * FROM rz)", "run_id", "pressure flow", "step grid"))
def _(spark, sf):
    return S.resampled(annotated(spark, sf), C, ["pressure", "flow"], 16, bound(spark, sf)).drop("_n")


@query("sequence_tensor", sql("run_rows", f"""+{resample_sql()}, k AS (SELECT DISTINCT run_id FROM ann), st AS (SELECT run_id, s AS step FROM k, range(0, 3) r(s)),
  res AS (SELECT st.run_id, st.step, count(grid) > 0 AS present, sum(pressure) AS p_sum, max(grid*n_rows/15.0::DOUBLE) AS elapsed_last
  FROM st LEFT JOIN rz USING (run_id, step) GROUP BY ALL)""", "run_id present", "p_sum elapsed_last", "step"))
def _(spark, sf):
    x = S.sequence_tensor(annotated(spark, sf), C, ["pressure", "flow"], 16, bound(spark, sf)).select("run_id", F.explode("steps").alias("s"))
    return x.select("run_id", "s.step", "s.present", F.aggregate("s.pressure", F.lit(0.0), lambda a, v: a + v).alias("p_sum"),
                    F.element_at("s.elapsed", -1).alias("elapsed_last"))


@query("trajectory_residual", sql("run_rows", f"""+{resample_sql()}, lz AS (SELECT run_id, step, grid, channel, v FROM rz UNPIVOT (v FOR channel IN (pressure, flow))),
  sc AS (SELECT step, channel, avg(v) AS m, stddev_pop(v) AS s FROM lz GROUP BY ALL),
  z AS (SELECT lz.*, g.grp, (v - m)/(s + 1e-6) AS z FROM lz JOIN sc USING (step, channel) JOIN (SELECT DISTINCT run_id, grp FROM ann) g USING (run_id)),
  md AS (SELECT grp, step, channel, grid, median(z) AS md FROM z GROUP BY ALL),
  res AS (SELECT run_id, step, channel, sqrt(avg((z - md)*(z - md))) AS resid FROM z JOIN md USING (grp, step, channel, grid) GROUP BY ALL)""",
                                  "run_id channel", "resid", "step"))
def _(spark, sf):
    rows = annotated(spark, sf)
    groups = rows.groupBy("run_id").agg(F.min("grp").alias("grp"))
    return S.trajectory_residual(rows, groups, C, ["pressure", "flow"], 16, "grp", bound(spark, sf))


# -- run table: schedule, lives, ranges -----------------------------------------------------------
def grp_rows(spark, sf):
    return key_rows(runs(spark, sf), ["grp"])


LIFE_SQL = """lf0 AS (SELECT *, lag(usage) OVER w AS pu FROM runs WINDOW w AS (PARTITION BY grp ORDER BY t_start, run_id)),
  lf AS (SELECT *, sum((coalesce(usage - pu, 0) < -200)::INT) OVER (PARTITION BY grp ORDER BY t_start, run_id) AS life FROM lf0)"""


def with_life(spark, sf):
    return R.life_ids(runs(spark, sf), ["grp"], "t_start", ["run_id"], "usage", 200, bound=grp_rows(spark, sf))


@query("life_ids", sql("runs", f"+{LIFE_SQL}, res AS (SELECT run_id, life FROM lf)", "run_id", "", "life"))
def _(spark, sf):
    return with_life(spark, sf).select("run_id", "life")


@query("life_position", sql("runs", f"""+{LIFE_SQL}, res AS (SELECT run_id, row_number() OVER o - 1 AS life_rows, (t_start - min(t_start) OVER p)/3600 AS life_hours,
  usage / greatest(max(usage) OVER p, 1) AS life_frac FROM lf WINDOW p AS (PARTITION BY grp, life), o AS (PARTITION BY grp, life ORDER BY t_start, run_id))""",
                            "run_id", "life_hours life_frac", "life_rows"))
def _(spark, sf):
    return R.life_position(with_life(spark, sf), ["grp"], "t_start", ["run_id"], "usage", bound=grp_rows(spark, sf)).select(
        "run_id", "life_rows", "life_hours", "life_frac")


SCHED = "gap_prev gap_prev_end gap_next log_gap_prev hours_since_idle"


@query("schedule_features", sql("runs", """+a AS (SELECT *, t_start - lag(t_start) OVER w AS gap_prev, lead(t_start) OVER w - t_start AS gap_next,
    t_start - max(t_end) OVER (PARTITION BY grp ORDER BY t_start, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_prev_end
    FROM runs WINDOW w AS (PARTITION BY grp ORDER BY t_start, run_id)),
  b AS (SELECT *, ln(1 + greatest(gap_prev, 0)) AS log_gap_prev, coalesce(gap_prev_end > 900, true) AS idle_long, coalesce(gap_prev > 600, true) AS nl FROM a),
  c AS (SELECT *, sum(idle_long::INT) OVER w AS spell, sum(nl::INT) OVER w AS lot, (t_start - max(CASE WHEN idle_long THEN t_start END) OVER w)/3600 AS hours_since_idle
    FROM b WINDOW w AS (PARTITION BY grp ORDER BY t_start, run_id)),
  res AS (SELECT *, row_number() OVER (PARTITION BY grp, spell ORDER BY t_start, run_id) - 1 AS spell_pos, count(*) OVER (PARTITION BY grp, spell) AS spell_len,
    row_number() OVER (PARTITION BY grp, lot ORDER BY t_start, run_id) - 1 AS lot_pos, count(*) OVER (PARTITION BY grp, lot) AS lot_len FROM c)""",
                                "run_id idle_long", "gap_prev gap_prev_end gap_next hours_since_idle", "spell lot spell_pos spell_len lot_pos lot_len"))
def _(spark, sf):
    out = R.schedule(runs(spark, sf).select("run_id", "grp", "t_start", "t_end"), ["grp"], "t_start", "t_end", ["run_id"], idle=900.0, bound=grp_rows(spark, sf))
    return out.select("run_id", "idle_long", "gap_prev", "gap_prev_end", "gap_next", "hours_since_idle", "spell", "lot", "spell_pos",
                      "spell_len", "lot_pos", "lot_len")


@query("range_counts", sql("runs", """SELECT run_id, (SELECT count(*) FROM runs b WHERE b.grp = a.grp AND b.t_start >= a.t_start - 3600 AND b.t_start < a.t_start) AS prev_1h,
  (SELECT count(*) FROM runs b WHERE b.grp = a.grp AND b.t_start >= a.t_start - 10800 AND b.t_start < a.t_start) AS prev_3h,
  (SELECT count(*) FROM runs b WHERE b.grp = a.grp AND b.t_start > a.t_start AND b.t_start <= a.t_start + 3600) AS next_1h FROM runs a""",
                           "run_id", "", "prev_1h prev_3h next_1h"))
def _(spark, sf):
    return range_counts(runs(spark, sf), ["grp"], "t_start", ["run_id"], {
        "prev_1h": (-3600.0, True, 0.0, False), "prev_3h": (-10800.0, True, 0.0, False), "next_1h": (0.0, False, 3600.0, True)},
        rows=grp_rows(spark, sf))


@query("rolling_counter_rate", sql("runs", """+a AS (SELECT *, duration AS inc, t_start - lag(t_start) OVER w AS gap FROM runs WINDOW w AS (PARTITION BY grp ORDER BY t_start, run_id)),
  res AS (SELECT run_id, sum(inc) OVER r AS inc_roll, sum(inc) OVER r / (greatest(sum(gap) OVER r, 60)/3600) AS rate_roll
  FROM a WINDOW r AS (PARTITION BY grp ORDER BY t_start, run_id ROWS 9 PRECEDING))""", "run_id", "inc_roll rate_roll"))
def _(spark, sf):
    b = grp_rows(spark, sf)
    o = Ordered(runs(spark, sf), ["grp"], "t_start", ["run_id"], b).running({"_p": ("lag", F.col("t_start"))})
    df = o.result().withColumns({"inc": F.col("duration"), "gap": F.col("t_start") - F.col("_p")})
    df = rolling_stats(df, ["grp"], "t_start", ["run_id"], [("inc", "r", 10), ("gap", "r", 10)], ("sum",), b)
    rate = F.col("inc_sum_r") / (F.greatest(F.col("gap_sum_r"), F.lit(60.0)) / 3600)
    return df.select("run_id", F.col("inc_sum_r").alias("inc_roll"), rate.alias("rate_roll"))


@query("partner_stage", sql("runs", """SELECT a.run_id, b.y AS other_y, (b.t_start - a.t_start)/3600 AS other_gap FROM runs a
  LEFT JOIN runs b ON a.wafer = b.wafer AND a.stage <> b.stage AND b.is_ref""", "run_id", "other_y other_gap"))
def _(spark, sf):
    out = R.partner_lookup(runs(spark, sf), "wafer", "stage", F.col("is_ref"), {"other_y": F.col("y"), "_ot": F.col("t_start")})
    return out.select("run_id", "other_y", ((F.col("_ot") - F.col("t_start")) / 3600).alias("other_gap"))


@query("group_median_deviation", sql("runs", """SELECT run_id, duration - median(duration) OVER (PARTITION BY regime) AS dev FROM runs""", "run_id", "dev"))
def _(spark, sf):
    from ..operators.quantiles import quantiles
    df = runs(spark, sf)
    out = join_keys(df, quantiles(df, ["regime"], ["duration"], {"med": 0.5}), ["regime"])
    return out.select("run_id", (F.col("duration") - F.col("duration_med")).alias("dev"))
