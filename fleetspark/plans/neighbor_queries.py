"""Folds, neighbour features and label-arrival features on the run table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrivals as A
from ..operators import folds as FO
from ..operators import neighbors as N
from ..operators.asof import asof
from ..operators.ordered import join_keys, key_rows
from ..operators.runs import life_ids
from .registry import query
from .run_queries import LIFE_SQL
from .views import runs, sql

STATE = ["usage", "pad", "film"]
H = "/3600.0::DOUBLE"
DRAW = "CAST('0x' || substr(md5(concat_ws('_', run_id, '{}')), 1, 8) AS BIGINT) / 4294967296.0"


def regime_rows(spark, sf):
    return key_rows(runs(spark, sf), ["regime"])


def narrow(spark, sf, *more):
    """Runs with the columns a query uses; an as-of lookup carries whole rows, so others would be stored and shuffled with them."""
    return runs(spark, sf).select("run_id", "regime", "y", *more)


# -- folds --------------------------------------------------------------------------------------
FOLD_SQL = f"fo AS (SELECT *, CAST(floor({DRAW.format('fold')} * 5) AS INT) AS fold FROM runs)"


@query("hash_folds", sql("runs", f"+{FOLD_SQL}, res AS (SELECT run_id, fold FROM fo)", "run_id", "", "fold"))
def _(spark, sf):
    return FO.kfold(runs(spark, sf), ["run_id"], 5).select("run_id", "fold")


@query("balanced_folds", sql("runs", f"SELECT run_id, (row_number() OVER (ORDER BY {DRAW.format('fold')}, run_id) - 1) % 5 AS fold FROM runs", "run_id", "", "fold"))
def _(spark, sf):
    return FO.balanced_kfold(runs(spark, sf), ["run_id"], 5).select("run_id", "fold")


@query("group_folds", sql("telemetry", """+s AS (SELECT tool, count(*) AS n FROM telemetry GROUP BY tool),
  r AS (SELECT tool, (row_number() OVER (ORDER BY n DESC, tool DESC) - 1) % 10 AS i FROM s),
  res AS (SELECT id, least(i, 9 - i) AS fold FROM telemetry JOIN r USING (tool))""", "id", "", "fold"))
def _(spark, sf):
    from .views import telemetry
    return FO.group_kfold(telemetry(spark, sf), "tool", 5).select("id", "fold")


# -- nearest in time ------------------------------------------------------------------------------
PAIRS = """pr AS (SELECT a.run_id AS i, a.t_start AS ti, b.run_id AS j, b.t_start AS tj, b.y, abs(a.t_start - b.t_start) AS d,
    CASE WHEN (b.t_start, b.run_id) < (a.t_start, a.run_id) THEN 0 ELSE 1 END AS side
    FROM {q} a JOIN {c} b ON a.regime = b.regime AND a.run_id <> b.run_id {cond}),
  nn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, side, CASE WHEN side = 0 THEN -j ELSE j END) AS rk FROM pr
    QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, side, CASE WHEN side = 0 THEN -j ELSE j END) <= 40)"""
KNN_COLS = "NB_time_1 NB_time_3 NB_time_10 NB_time_dist1 NB_trend_15 NB_slope_15 NB_trend_40 NB_slope_40"


def line_sql(n):
    x = "(tj - ti)/3600.0::DOUBLE"
    return f"""least(greatest(avg(y) FILTER (rk <= {n}) - coalesce(regr_slope(y, {x}) FILTER (rk <= {n}), 0) * avg({x}) FILTER (rk <= {n}),
      min(y) FILTER (rk <= {n})), max(y) FILTER (rk <= {n})) AS NB_trend_{n}, coalesce(regr_slope(y, {x}) FILTER (rk <= {n}), 0) AS NB_slope_{n}"""


KNN = f"""kn AS (SELECT i AS run_id, avg(y) FILTER (rk <= 1) AS NB_time_1, avg(y) FILTER (rk <= 3) AS NB_time_3, avg(y) FILTER (rk <= 10) AS NB_time_10,
    min(d)/3600.0::DOUBLE AS NB_time_dist1, {line_sql(15)}, {line_sql(40)} FROM nn GROUP BY i)"""


@query("nearest_in_time", sql("runs", f"""+{PAIRS.format(q='runs', c='runs', cond='AND b.is_ref')}, {KNN},
  res AS (SELECT r.run_id, kn.* EXCLUDE (run_id) FROM runs r LEFT JOIN kn USING (run_id))""", "run_id", KNN_COLS))
def _(spark, sf):
    df = narrow(spark, sf, "t_start", "is_ref")
    out = N.time_neighbors(df, df.filter("is_ref"), ["regime"], "t_start", "run_id", "y", rows=regime_rows(spark, sf))
    return out.select("run_id", *KNN_COLS.split())


@query("nearest_in_time_inner_folds", sql("runs", f"""+{FOLD_SQL}, {PAIRS.format(q='fo', c='fo', cond='AND b.is_ref AND (NOT a.is_ref OR a.fold <> b.fold)')}, {KNN},
  res AS (SELECT r.run_id, kn.* EXCLUDE (run_id) FROM runs r LEFT JOIN kn USING (run_id))""", "run_id", "NB_time_1 NB_time_3 NB_time_10 NB_time_dist1"))
def _(spark, sf):
    df = FO.kfold(narrow(spark, sf, "t_start", "is_ref"), ["run_id"], 5)
    q, c = FO.inner_views(df, F.col("is_ref"), "fold", 5)
    out = N.time_neighbors(q, c, ["regime", "view"], "t_start", "run_id", "y", trends=(), rows=regime_rows(spark, sf))
    return out.select("run_id", "NB_time_1", "NB_time_3", "NB_time_10", "NB_time_dist1")


@query("out_of_fold_neighbors", sql("runs", f"""+{FOLD_SQL}, v AS (SELECT f AS view, fo.* FROM fo, range(0, 5) r(f)),
  pr AS (SELECT a.view, a.run_id, b.y, row_number() OVER (PARTITION BY a.view, a.run_id ORDER BY abs(a.t_start - b.t_start),
      CASE WHEN (b.t_start, b.run_id) < (a.t_start, a.run_id) THEN 0 ELSE 1 END, CASE WHEN (b.t_start, b.run_id) < (a.t_start, a.run_id) THEN -b.run_id ELSE b.run_id END) AS rk
    FROM v a JOIN fo b ON a.regime = b.regime AND a.run_id <> b.run_id AND b.is_ref AND b.fold <> a.view AND abs(a.t_start - b.t_start) < 1200000),
  res AS (SELECT view, run_id, avg(y) FILTER (rk <= 3) AS NB_time_3 FROM pr GROUP BY ALL)""", "run_id", "NB_time_3", "view"))
def _(spark, sf):
    q, c = FO.outer_views(FO.kfold(narrow(spark, sf, "t_start", "is_ref"), ["run_id"], 5), F.col("is_ref"), "fold", 5)
    return N.time_neighbors(q, c, ["regime", "view"], "t_start", "run_id", "y", ks=(3,), trends=(), rows=regime_rows(spark, sf)).select(
        "view", "run_id", "NB_time_3")


@query("nearest_in_state", sql("runs", """+ sc AS (SELECT stddev_samp(usage) AS a, stddev_samp(pad) AS b, stddev_samp(film) AS c FROM runs WHERE is_ref),
  z AS (SELECT run_id, regime, is_ref, y, usage/a AS u, pad/b AS p, film/c AS f FROM runs, sc),
  pr AS (SELECT x.run_id, w.run_id AS j, w.y, sqrt((x.u-w.u)*(x.u-w.u) + (x.p-w.p)*(x.p-w.p) + (x.f-w.f)*(x.f-w.f)) AS d
    FROM z x JOIN z w ON x.regime = w.regime AND x.run_id <> w.run_id AND w.is_ref),
  tk AS (SELECT run_id, list(struct_pack(d := round(d, 9), y := y) ORDER BY round(d, 9), j) AS l FROM
    (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY round(d, 9), j) <= 10) GROUP BY run_id),
  res AS (SELECT run_id, l[1].d AS dist1, l[1].y AS y1, list_avg(list_transform(l[1:3], lambda s: s.y)) AS y3, list_avg(list_transform(l, lambda s: s.y)) AS y10 FROM tk)""",
                               "run_id", "dist1 y1 y3 y10"))
def _(spark, sf):
    df = runs(spark, sf)
    sd = df.filter("is_ref").agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in STATE])
    z = df.crossJoin(F.broadcast(sd)).withColumns({c: F.col(c) / F.col(f"_sd_{c}") for c in STATE})  # one row of scales
    out = N.state_neighbors(z, z.filter("is_ref"), ["regime"], STATE, "run_id", "y", 10, regime_rows(spark, sf))
    return out.select("run_id", F.get("_state", F.lit(0))["d"].alias("dist1"), F.get("_state", F.lit(0))["y"].alias("y1"),
                      N.mean_of(F.col("_state"), "y", 3).alias("y3"), N.mean_of(F.col("_state"), "y", 10).alias("y10"))


FACTORS = [[1.0, 1.0, 1.0], [2.0, 0.5, 0.1]]


@query("weighted_state_at_scales", sql("runs", """+ sc AS (SELECT stddev_samp(usage) AS a, stddev_samp(pad) AS b, stddev_samp(film) AS c FROM runs WHERE is_ref),
  fs AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (1, 2.0, 0.5, 0.1)) v(trial, fu, fp, ff)),
  z AS (SELECT run_id, regime, is_ref, y, trial, usage*fu/a AS u, pad*fp/b AS p, film*ff/c AS f FROM runs, sc, fs),
  pr AS (SELECT x.run_id, x.trial, w.y, w.run_id AS j, round(sqrt((x.u-w.u)*(x.u-w.u) + (x.p-w.p)*(x.p-w.p) + (x.f-w.f)*(x.f-w.f)), 9) AS d
    FROM z x JOIN z w ON x.regime = w.regime AND x.trial = w.trial AND x.run_id <> w.run_id AND w.is_ref),
  tk AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY run_id, trial ORDER BY d, j) <= 8),
  pd AS (SELECT run_id, trial, sum(y / (d + 1e-3)) / sum(1 / (d + 1e-3)) AS pred FROM tk GROUP BY ALL),
  res AS (SELECT r.run_id, fs.trial, pred FROM runs r CROSS JOIN fs LEFT JOIN pd ON pd.run_id = r.run_id AND pd.trial = fs.trial)""", "run_id", "pred", "trial"))
def _(spark, sf):
    """The predictor of ``weighted_state_regressor`` at two given sets of scales, found in one search."""
    df = runs(spark, sf)
    ref = df.filter("is_ref")
    sd = ref.agg(*[F.stddev_samp(c).alias(c) for c in STATE]).head()  # one row of scales
    index = N.StateIndex(ref, ["regime"], STATE, "run_id", "y", regime_rows(spark, sf))
    found = index.search(index.asking(df), 8, [[f / sd[c] for f, c in zip(row, STATE)] for row in FACTORS])
    all_rows = df.select("regime", "run_id").withColumn("_trial", F.explode(F.array(F.lit(0), F.lit(1))))
    return join_keys(all_rows, found, ["regime", "run_id", "_trial"]).select("run_id", F.col("_trial").alias("trial"), N.nearest_weighted(8).alias("pred"))


# -- sequence and extended neighbours ---------------------------------------------------------------
DEV_SQL = "dv AS (SELECT *, y - mu AS dev FROM (SELECT *, avg(CASE WHEN is_ref THEN y END) OVER (PARTITION BY regime) AS mu FROM {src}))"


def with_dev(df):
    return N.deviations(df, F.col("is_ref"), ["regime"], "y")


@query("deviation_from_regime_mean", sql("runs", f"+{DEV_SQL.format(src='runs')}, res AS (SELECT * FROM dv)", "run_id", "mu dev"))
def _(spark, sf):
    return with_dev(runs(spark, sf)).select("run_id", "mu", "dev")


def cross(df):
    """Candidates re-keyed to the regime they serve: same group, other stage."""
    return df.withColumn("regime", F.concat(F.col("grp").cast("string"), F.when(F.col("stage") == "A", "B").otherwise("A")))


CROSS = "CAST(b.grp AS VARCHAR) || CASE WHEN b.stage = 'A' THEN 'B' ELSE 'A' END"
SEQ_COLS = [f"{n}_{s}" for n in ("same", "cross") for s in ("prev1", "prev3", "prev_gap", "next1", "next3", "next_gap")]


def seq_sql(name, key):
    return f"""{name}p AS (SELECT a.run_id, (a.t_start - b.t_start){H} AS gap, b.dev, row_number() OVER (PARTITION BY a.run_id ORDER BY b.t_start DESC, b.run_id DESC) AS rk
      FROM dv a JOIN dv b ON a.regime = {key} AND b.is_ref AND b.t_start < a.t_start AND b.run_id <> a.run_id AND b.t_start >= a.t_start - 720000),
  {name}n AS (SELECT a.run_id, (b.t_start - a.t_start){H} AS gap, b.dev, row_number() OVER (PARTITION BY a.run_id ORDER BY b.t_start, b.run_id) AS rk
      FROM dv a JOIN dv b ON a.regime = {key} AND b.is_ref AND b.t_start >= a.t_start AND b.run_id <> a.run_id AND b.t_start <= a.t_start + 720000),
  {name} AS (SELECT * FROM (SELECT run_id, max(dev) FILTER (rk = 1) AS {name}_prev1, avg(dev) FILTER (rk <= 3) AS {name}_prev3, max(gap) FILTER (rk = 1) AS {name}_prev_gap FROM {name}p GROUP BY 1)
    FULL JOIN (SELECT run_id, max(dev) FILTER (rk = 1) AS {name}_next1, avg(dev) FILTER (rk <= 3) AS {name}_next3, max(gap) FILTER (rk = 1) AS {name}_next_gap FROM {name}n GROUP BY 1) USING (run_id))"""


@query("sequence_neighbors", sql("runs", f"""+{DEV_SQL.format(src='runs')}, {seq_sql('same', 'b.regime')}, {seq_sql('cross', CROSS)},
  res AS (SELECT * FROM runs LEFT JOIN same USING (run_id) LEFT JOIN "cross" USING (run_id))""".replace(" cross AS", ' "cross" AS'), "run_id", " ".join(SEQ_COLS)))
def _(spark, sf):
    b = regime_rows(spark, sf)
    df = with_dev(narrow(spark, sf, "t_start", "is_ref", "grp", "stage"))
    ref = df.filter("is_ref")
    out = N.sequence_neighbors(df, ref, ["regime"], "t_start", "run_id", "dev", "same", 3, b)
    out = N.sequence_neighbors(out, cross(ref), ["regime"], "t_start", "run_id", "dev", "cross", 3, b)
    return out.select("run_id", *SEQ_COLS)


HOURS, COUNTS = {"h0.5": 0.5, "h2": 2.0, "h8": 8.0}, {"c2": 2.0, "c5": 5.0, "c15": 15.0}


def ewm_sql(name, op, sign):
    hs = ", ".join(f"CASE WHEN sum(pow(0.5, age/{h})) >= 1e-3 THEN sum(pow(0.5, age/{h})*dev)/sum(pow(0.5, age/{h})) END AS \"{name}_{n}\"" for n, h in HOURS.items())
    cs = ", ".join(f"sum(pow(2, -(rk-1)/{c}::DOUBLE)*dev)/sum(pow(2, -(rk-1)/{c}::DOUBLE)) AS {name}_{n}" for n, c in COUNTS.items())
    return f"""{name} AS (SELECT run_id, {hs}, {cs} FROM (SELECT a.run_id, b.dev, abs(a.t_start - b.t_start){H} AS age,
      row_number() OVER (PARTITION BY a.run_id ORDER BY abs(a.t_start - b.t_start), {sign}b.run_id) AS rk
      FROM dv a JOIN dv b ON a.regime = b.regime AND b.is_ref AND (NOT a.is_ref OR a.fold <> b.fold) AND b.t_start {op} a.t_start) GROUP BY run_id)"""


EWM_COLS = [f"{s}_{n}" for s in ("past", "fut") for n in [*HOURS, *COUNTS]]


@query("ewm_neighbors_inner_folds", sql("runs", f"""+{FOLD_SQL}, {DEV_SQL.format(src='fo')}, {ewm_sql('past', '<', '-')}, {ewm_sql('fut', '>', '')},
  res AS (SELECT * FROM runs LEFT JOIN past USING (run_id) LEFT JOIN fut USING (run_id))""".replace('"past_h0.5"', 'past_h05').replace('"fut_h0.5"', 'fut_h05'),
                                        "run_id", " ".join(c.replace(".", "") for c in EWM_COLS)))
def _(spark, sf):
    b = regime_rows(spark, sf)
    q, c = FO.inner_views(with_dev(FO.kfold(narrow(spark, sf, "t_start", "is_ref"), ["run_id"], 5)), F.col("is_ref"), "fold", 5)
    hours = {n.replace(".", ""): h for n, h in HOURS.items()}
    out = q
    for side, name in (("prev", "past_"), ("next", "fut_")):
        out = N.ewm_features(out, c, ["regime", "view"], "t_start", "run_id", "dev", hours, COUNTS, name, side, rows=b)
    return out.select("run_id", *[c.replace(".", "") for c in EWM_COLS])


@query("state_change_since_neighbor", sql("runs", """+p AS (SELECT a.run_id, a.usage - b.usage AS prev_usage, a.pad - b.pad AS prev_pad FROM runs a ASOF JOIN
    (SELECT * FROM runs WHERE is_ref QUALIFY row_number() OVER (PARTITION BY regime, t_start ORDER BY run_id DESC) = 1) b ON a.regime = b.regime AND a.t_start > b.t_start),
  n AS (SELECT a.run_id, a.usage - b.usage AS next_usage, a.pad - b.pad AS next_pad FROM runs a ASOF JOIN
    (SELECT * FROM runs WHERE is_ref QUALIFY row_number() OVER (PARTITION BY regime, t_start ORDER BY run_id) = 1) b ON a.regime = b.regime AND a.t_start < b.t_start),
  res AS (SELECT * FROM runs LEFT JOIN p USING (run_id) LEFT JOIN n USING (run_id))""", "run_id", "prev_usage prev_pad next_usage next_pad"))
def _(spark, sf):
    df = runs(spark, sf)
    out = N.neighbor_deltas(df, df.filter("is_ref"), ["regime"], "t_start", "run_id", ["usage", "pad"], "", regime_rows(spark, sf))
    return out.select("run_id", "prev_usage", "prev_pad", "next_usage", "next_pad")


# -- kernels --------------------------------------------------------------------------------------
@query("leave_one_out_kernels", sql("runs", """+pr AS (SELECT a.run_id, b.y, abs(a.t_start - b.t_start)/3600.0::DOUBLE AS d FROM runs a JOIN runs b
    ON a.regime = b.regime AND b.is_ref AND a.run_id <> b.run_id AND abs(a.t_start - b.t_start) <= 9*4*3600),
  k AS (SELECT run_id, sum(exp(-0.5*d*d)) AS n_g1, sum(exp(-0.5*d*d)*y) AS s1, sum(exp(-0.5*d*d/16)) AS n_g4, sum(exp(-0.5*d*d/16)*y) AS s4 FROM pr GROUP BY run_id),
  res AS (SELECT run_id, coalesce(n_g1, 0) AS n_g1, CASE WHEN n_g1 >= 1e-3 THEN s1/n_g1 END AS k_g1, coalesce(n_g4, 0) AS n_g4, CASE WHEN n_g4 >= 1e-3 THEN s4/n_g4 END AS k_g4
    FROM runs LEFT JOIN k USING (run_id))""", "run_id", "n_g1 k_g1 n_g4 k_g4"))
def _(spark, sf):
    df = runs(spark, sf)
    out = N.kernel_sums(df, df.filter("is_ref"), ["regime"], "t_start", "y", {"g1": ("gauss", 1.0), "g4": ("gauss", 4.0)}, F.col("is_ref"))
    return out.select("run_id", "n_g1", "k_g1", "n_g4", "k_g4")


@query("same_life_kernel", sql("runs", f"""+{LIFE_SQL}, k AS (SELECT a.run_id, sum(exp(-0.5*pow((a.t_start-b.t_start)/14400, 2))) AS n, sum(exp(-0.5*pow((a.t_start-b.t_start)/14400, 2))*b.y) AS s
    FROM lf a JOIN lf b ON a.regime = b.regime AND a.life = b.life AND b.is_ref AND a.run_id <> b.run_id AND abs(a.t_start - b.t_start) <= 129600 GROUP BY 1),
  res AS (SELECT run_id, coalesce(n, 0) AS n_g4, CASE WHEN n >= 1e-3 THEN s/n END AS k_g4 FROM runs LEFT JOIN k USING (run_id))""", "run_id", "n_g4 k_g4"))
def _(spark, sf):
    df = life_ids(runs(spark, sf), ["grp"], "t_start", ["run_id"], "usage", 200, bound=key_rows(runs(spark, sf), ["grp"]))
    out = N.kernel_sums(df, df.filter("is_ref"), ["regime", "life"], "t_start", "y", {"g4": ("gauss", 4.0)}, F.col("is_ref"))
    return out.select("run_id", "n_g4", "k_g4")


@query("same_life_usage_kernel", sql("runs", f"""+{LIFE_SQL}, k AS (SELECT a.run_id, sum(exp(-0.5*pow((a.usage-b.usage)/15, 2))) AS n, sum(exp(-0.5*pow((a.usage-b.usage)/15, 2))*b.y) AS s
    FROM lf a JOIN lf b ON a.regime = b.regime AND a.life = b.life AND b.is_ref AND a.run_id <> b.run_id AND abs(a.usage - b.usage) <= 135 GROUP BY 1),
  res AS (SELECT run_id, coalesce(n, 0) AS n_u15, CASE WHEN n >= 1e-3 THEN s/n END AS k_u15 FROM runs LEFT JOIN k USING (run_id))""", "run_id", "n_u15 k_u15"))
def _(spark, sf):
    df = life_ids(runs(spark, sf), ["grp"], "t_start", ["run_id"], "usage", 200, bound=key_rows(runs(spark, sf), ["grp"]))
    # kernel_sums measures distance in hours of its axis; usage counts are put on that axis by a factor of 3600
    df = df.withColumn("usage_axis", F.col("usage") * 3600.0)
    out = N.kernel_sums(df, df.filter("is_ref"), ["regime", "life"], "usage_axis", "y", {"u15": ("gauss", 15.0)}, F.col("is_ref"))
    return out.select("run_id", "n_u15", "k_u15")


@query("tricube_local_line", sql("runs", """+pr AS (SELECT a.run_id, b.y, (a.t_start - b.t_start)/3600.0::DOUBLE AS d, pow(1 - pow(abs(a.t_start - b.t_start)/21600.0::DOUBLE, 3), 3) AS w
    FROM runs a JOIN runs b ON a.regime = b.regime AND b.is_ref AND a.run_id <> b.run_id AND abs(a.t_start - b.t_start) < 21600),
  s AS (SELECT run_id, sum(w) s0, sum(w*d) s1, sum(w*d*d) s2, sum(w*y) t0, sum(w*d*y) t1, min(y) lo, max(y) hi FROM pr GROUP BY 1),
  res AS (SELECT run_id, CASE WHEN s0 >= 3e-3 AND s0*s2-s1*s1 > 1e-9 THEN least(greatest((s2*t0-s1*t1)/(s0*s2-s1*s1), lo), hi) END AS L_est,
    CASE WHEN s0 >= 3e-3 AND s0*s2-s1*s1 > 1e-9 THEN (s0*t1-s1*t0)/(s0*s2-s1*s1) END AS L_slope FROM runs LEFT JOIN s USING (run_id))""", "run_id", "L_est L_slope:2"))
def _(spark, sf):
    df = runs(spark, sf)
    return N.local_line(df, df.filter("is_ref"), ["regime"], "t_start", "run_id", "y", 6.0, F.col("is_ref"), "L_").select("run_id", "L_est", "L_slope")


# -- label arrival ----------------------------------------------------------------------------------
LAG = A.Clock(delay=3600.0, lag=6 * 3600.0)
NOLAG = A.Clock(delay=3600.0, lag=0.0)


@query("arrival_clock", sql("runs", """SELECT run_id, t_end + 3600 AS arrive, t_end + 21600 AS issue, greatest(t_end + 3600, t_end + 21600) AS ready,
  CASE WHEN measured THEN y END AS ym FROM runs""", "run_id", "arrive issue ready ym"))
def _(spark, sf):
    return A.clock_columns(runs(spark, sf), LAG).select("run_id", "arrive", "issue", "ready", "ym")


E_NAMES = [*A.EWM_HOURS, *A.EWM_COUNTS]


def block_sql(name, cond, prefix, pos, trends):
    hs = ", ".join(f"CASE WHEN sum(pow(0.5, age/{h})) > 1e-3 THEN sum(pow(0.5, age/{h})*y)/sum(pow(0.5, age/{h})) END AS {prefix}{n.replace('.', '')}" for n, h in A.EWM_HOURS.items())
    cs = ", ".join(f"CASE WHEN sum(pow(0.5, (rk-1)/{c})) > 1e-3 THEN sum(pow(0.5, (rk-1)/{c})*y)/sum(pow(0.5, (rk-1)/{c})) END AS {prefix}{n}" for n, c in A.EWM_COUNTS.items())
    x = "(tj - ti)/3600.0::DOUBLE"
    tr = ", ".join(f"CASE WHEN count(*) FILTER (rk <= {k}) >= 5 THEN least(greatest(avg(y) FILTER (rk <= {k}) - coalesce(regr_slope(y, {x}) FILTER (rk <= {k}), 0) * avg({x}) FILTER (rk <= {k}), min(y) FILTER (rk <= {k})), max(y) FILTER (rk <= {k})) END AS {prefix}trend{k}" for k in trends)
    return f"""{name} AS (SELECT run_id, count(*) AS {prefix}n, max(y) FILTER (rk = 1) AS {prefix}1, avg(y) FILTER (rk <= 3) AS {prefix}mean3, avg(y) FILTER (rk <= 10) AS {prefix}mean10,
      avg(y) AS {prefix}mean_all, max(age) FILTER (rk = 1) AS {prefix}age1, count(*) FILTER (age < 24) AS {prefix}n24, {hs}, {cs}, {tr}
    FROM (SELECT a.run_id, b.y, a.t_end AS ti, b.t_end AS tj, abs(a.t_end - b.t_end)/3600.0::DOUBLE AS age, row_number() OVER (PARTITION BY a.run_id ORDER BY {pos}) AS rk
      FROM runs a JOIN runs b ON a.regime = b.regime AND b.measured AND a.run_id <> b.run_id AND {cond}) GROUP BY run_id)"""


PCOLS = "P_last1 P_mean3 P_mean10 P_mean_all P_age1 P_trend15 P_trend40 " + " ".join(f"P_{n.replace('.', '')}" for n in E_NAMES)


def past(spark, sf, clock):
    df = narrow(spark, sf, "t_end", "measured")
    out = A.past_block(df, df.filter("measured"), ["regime"], clock, rows=regime_rows(spark, sf))
    return out.select("run_id", "P_n", "P_n24", *[c for c in out.columns
                                                  if c.startswith("P_") and c not in ("P_n", "P_n24")])


for _name, _clock, _cond in (("history_of_arrived_labels", NOLAG, "b.t_end <= a.t_end - 3600"),
                             ("history_at_fixed_lag", LAG, "(b.t_end, b.run_id) < (a.t_end, a.run_id)")):
    query(_name, sql("runs", f"""+{block_sql('h', _cond, 'P_', 'b.t_end DESC, b.run_id DESC', (15, 40))},
      res AS (SELECT run_id, coalesce(P_n, 0) AS P_n, P_1 AS P_last1, h.* EXCLUDE (run_id, P_n, P_1) FROM runs LEFT JOIN h USING (run_id))""", "run_id", PCOLS, "P_n P_n24"))(
        lambda spark, sf, _clock=_clock: past(spark, sf, _clock))

FCOLS = "F_next1 F_mean3 F_mean10 F_age1 F_trend15 " + " ".join(f"F_{n.replace('.', '')}" for n in E_NAMES)


@query("look_ahead_labels", sql("runs", f"""+{block_sql('h', '(b.t_end, b.run_id) > (a.t_end, a.run_id) AND b.t_end <= a.t_end + 18000', 'F_', 'b.t_end, b.run_id', (15,))},
  res AS (SELECT run_id, coalesce(F_n, 0) AS F_n, F_1 AS F_next1, h.* EXCLUDE (run_id, F_n, F_1) FROM runs LEFT JOIN h USING (run_id))""", "run_id", FCOLS, "F_n F_n24"))
def _(spark, sf):
    df = narrow(spark, sf, "t_end", "measured")
    out = A.ahead_block(df, df.filter("measured"), ["regime"], LAG, rows=regime_rows(spark, sf))
    return out.select("run_id", "F_n", "F_n24", *[c for c in out.columns
                                                  if c.startswith("F_") and c not in ("F_n", "F_n24")])


@query("same_life_history", sql("runs", f"""+{LIFE_SQL}, h AS (SELECT a.run_id, avg(b.y) AS m, count(*) AS n FROM lf a JOIN lf b ON a.regime = b.regime AND a.life = b.life
    AND b.measured AND a.run_id <> b.run_id AND b.t_end <= a.t_end - 3600 GROUP BY 1),
  res AS (SELECT run_id, m AS P_life_mean, coalesce(n, 0) AS P_life_n FROM runs LEFT JOIN h USING (run_id))""", "run_id", "P_life_mean", "P_life_n"))
def _(spark, sf):
    df = life_ids(runs(spark, sf), ["grp"], "t_start", ["run_id"], "usage", 200, bound=key_rows(runs(spark, sf), ["grp"]))
    return A.life_block(df, df.filter("measured"), ["regime"], NOLAG, "life", rows=regime_rows(spark, sf)).select("run_id", "P_life_mean", "P_life_n")


CBLOCK = "last1 mean3 age1 ewmh2 ewmh8"


@query("cross_regime_history", sql("runs", f"""+{block_sql('h', 'b.t_end <= a.t_end - 3600', 'C_', 'b.t_end DESC, b.run_id DESC', (15,)).replace('a.regime = b.regime', 'a.regime = ' + CROSS)},
  res AS (SELECT run_id, coalesce(C_n, 0) AS C_n, C_1 AS C_last1, C_mean3, C_age1, C_ewmh2, C_ewmh8 FROM runs LEFT JOIN h USING (run_id))""",
                                   "run_id", " ".join(f"C_{c}" for c in CBLOCK.split()), "C_n"))
def _(spark, sf):
    df = narrow(spark, sf, "t_end", "measured", "grp", "stage")
    out = A.past_block(df, cross(df.filter("measured")), ["regime"], NOLAG, "C_", regime_rows(spark, sf))
    return out.select("run_id", "C_n", *[f"C_{c}" for c in CBLOCK.split()])


@query("arrived_partner_stage", sql("runs", """SELECT a.run_id, b.y AS O_y, (b.t_end - a.t_end)/3600.0::DOUBLE AS O_lag FROM runs a LEFT JOIN runs b
  ON a.wafer = b.wafer AND a.stage <> b.stage AND b.measured AND b.t_end + 3600 <= a.t_end + 21600""", "run_id", "O_y O_lag"))
def _(spark, sf):
    return A.partner_arrived(runs(spark, sf), LAG).select("run_id", "O_y", "O_lag")


TWO = "NN1 NN3 INT K025 K1 K4"


def two_sql(cond):
    k = ", ".join(f"sum(exp(-0.5*(d*d - d0*d0)/({h}*{h}))*y)/sum(exp(-0.5*(d*d - d0*d0)/({h}*{h}))) AS K{n}" for n, h in (("025", 0.25), ("1", 1.0), ("4", 4.0)))
    return f"""pr AS (SELECT a.run_id, a.t_end AS ti, b.y, b.t_end AS tj, abs(a.t_end-b.t_end)/3600.0::DOUBLE AS d, CASE WHEN (b.t_end, b.run_id) < (a.t_end, a.run_id) THEN 0 ELSE 1 END AS side, b.run_id AS j
      FROM runs a JOIN runs b ON a.regime = b.regime AND b.measured AND a.run_id <> b.run_id AND {cond}),
  p2 AS (SELECT *, min(d) OVER (PARTITION BY run_id) AS d0, row_number() OVER (PARTITION BY run_id ORDER BY d, side, j) AS rk,
      row_number() OVER (PARTITION BY run_id, side ORDER BY CASE WHEN side = 0 THEN -tj ELSE tj END, CASE WHEN side = 0 THEN -j ELSE j END) AS sk FROM pr),
  ag AS (SELECT run_id, any_value(ti) AS ti, max(y) FILTER (rk = 1) AS NN1, avg(y) FILTER (rk <= 3) AS NN3, max(y) FILTER (side = 0 AND sk = 1) AS y1, max(tj) FILTER (side = 0 AND sk = 1) AS t1,
      max(y) FILTER (side = 1 AND sk = 1) AS y2, max(tj) FILTER (side = 1 AND sk = 1) AS t2, {k} FROM p2 GROUP BY run_id),
  res AS (SELECT r.run_id, NN1, NN3, coalesce(y1 + (y2-y1)*(ti-t1)/greatest(t2-t1, 3.6e-6), y1, y2) AS INT, K025, K1, K4 FROM runs r LEFT JOIN ag USING (run_id))"""


for _name, _clock, _cond in (("two_sided_estimates", LAG, "((b.t_end, b.run_id) < (a.t_end, a.run_id) OR b.t_end <= a.t_end + 18000)"),
                             ("one_sided_estimates", NOLAG, "b.t_end <= a.t_end - 3600")):
    def _two(spark, sf, _clock=_clock):
        df = narrow(spark, sf, "t_end", "measured")
        out = A.two_sided(df, df.filter("measured"), ["regime"], _clock, rows=regime_rows(spark, sf))
        return out.select("run_id", "NN1", "NN3", "INT", "K025", "K1", "K4")
    query(_name, sql("runs", f"+{two_sql(_cond)}", "run_id", TWO))(_two)


@query("fallback_chain", sql("runs", """+p AS (SELECT *, CASE WHEN run_id % 3 = 0 THEN y * 1.01 END AS pred FROM runs),
  res AS (SELECT p.run_id, coalesce(pred, (SELECT avg(b.y) FROM runs b WHERE b.regime = p.regime AND b.measured AND b.run_id <> p.run_id AND b.t_end <= p.t_end - 3600),
    (SELECT avg(b.y) FROM runs b WHERE b.measured AND b.run_id <> p.run_id AND b.t_end <= p.t_end - 3600)) AS final, pred IS NULL AS final_fallback FROM p)""",
                             "run_id final_fallback", "final"))
def _(spark, sf):
    df = runs(spark, sf).withColumn("pred", F.when(F.col("run_id") % 3 == 0, F.col("y") * 1.01))
    out = A.fallback(df, df.filter("measured"), ["regime"], NOLAG, "pred", rows=regime_rows(spark, sf))
    return out.select("run_id", "final_fallback", "final")


@query("asof_previous_and_next_label", sql("runs", """SELECT a.run_id, p.y AS prev_y, (a.t_start - p.t_start)/3600.0::DOUBLE AS prev_gap FROM runs a ASOF LEFT JOIN
  (SELECT * FROM runs WHERE is_ref QUALIFY row_number() OVER (PARTITION BY regime, t_start ORDER BY run_id DESC) = 1) p ON a.regime = p.regime AND a.t_start > p.t_start""",
                                           "run_id", "prev_y prev_gap"))
def _(spark, sf):
    df = runs(spark, sf)
    out = asof(df, df.filter("is_ref"), ["regime"], F.col("t_start"), F.col("t_start"), {"y": F.col("y"), "t": F.col("t_start")},
               rtie=F.col("run_id"), rows=regime_rows(spark, sf))
    return out.select("run_id", F.col("hit.y").alias("prev_y"), ((F.col("t_start") - F.col("hit.t")) / 3600).alias("prev_gap"))
