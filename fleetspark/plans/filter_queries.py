"""Sequential filters on the run stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrivals as A
from ..operators import filters as FL
from ..operators.runs import life_ids
from ..operators.ordered import key_rows
from .blend_queries import M, members
from .neighbor_queries import NOLAG, block_sql, narrow, regime_rows
from .registry import query, twin
from .run_queries import LIFE_SQL
from .views import runs, sql


def labels(spark, sf):
    return runs(spark, sf).filter("measured")


def rec_sql(init, step, cols):
    """Recursive fold over the measured labels of each regime."""
    return f"""sq AS (SELECT *, row_number() OVER w AS rn, (t_end - lag(t_end) OVER w)/3600.0::DOUBLE AS dt, coalesce(life <> lag(life) OVER w, false) AS fresh
      FROM lf WHERE measured WINDOW w AS (PARTITION BY regime ORDER BY t_end, run_id)),
  rc AS (SELECT regime, run_id, rn, {init} FROM sq WHERE rn = 1 UNION ALL SELECT s.regime, s.run_id, s.rn, {step} FROM rc JOIN sq s ON s.regime = rc.regime AND s.rn = rc.rn + 1),
  res AS (SELECT run_id, {cols} FROM rc)"""


def recursive(text):
    return twin(text.replace("WITH ", "WITH RECURSIVE ", 1), text.places)


def with_lives(spark, sf, *cols):
    df = runs(spark, sf)
    return life_ids(df.select(*cols) if cols else df, ["grp"], "t_start", ["run_id"], "usage", 200, bound=key_rows(runs(spark, sf), ["grp"]))


@query("ewma_level", recursive(sql("runs", f"+{LIFE_SQL}, " + rec_sql("y AS level", "0.3*s.y + 0.7*rc.level", "level"), "run_id", "level")))
def _(spark, sf):
    return FL.ewma_level(labels(spark, sf), ["regime"], "t_end", ["run_id"], "y", 0.3, rows=regime_rows(spark, sf)).select("run_id", "level")


@query("ewma_level_with_reset", recursive(sql("runs", f"+{LIFE_SQL}, " + rec_sql(
    "y AS level", "CASE WHEN s.fresh THEN 0.9*s.y + 0.1*rc.level ELSE 0.3*s.y + 0.7*rc.level END", "level"), "run_id", "level")))
def _(spark, sf):
    df = with_lives(spark, sf).filter("measured")
    return FL.ewma_level(df, ["regime"], "t_end", ["run_id"], "y", 0.3, "life", 0.9, rows=regime_rows(spark, sf)).select("run_id", "level")


QH, QJ = 0.2, 0.1
_pp = f"(rc.p + {QH}*s.dt + CASE WHEN s.dt > 0.25 THEN {QJ} ELSE 0 END)"


@query("local_level_filter", recursive(sql("runs", f"+{LIFE_SQL}, " + rec_sql(
    "y AS m, 1.0::DOUBLE AS p", f"rc.m + {_pp}/({_pp} + 1)*(s.y - rc.m), {_pp}*(1 - {_pp}/({_pp} + 1))", "m, p"), "run_id", "m p")))
def _(spark, sf):
    x = FL.local_level(labels(spark, sf), ["regime"], "t_end", "run_id", "y", F.lit(QH), F.lit(QJ), regime_rows(spark, sf))
    return x.select("run_id", "m", "p")


def smooth(spark, sf):
    df = narrow(spark, sf, "t_end", "measured")
    return FL.fixed_lag_smoother(df, df.filter("measured"), ["regime"], "t_end", "run_id", "y", F.lit(QH), F.lit(QJ), 18000.0, regime_rows(spark, sf))


# Backward filter over the look-ahead labels of every row as a recursive fold from the last visible label.
BACK_SQL = f"""fl AS (SELECT run_id, regime, t_end, y, row_number() OVER (PARTITION BY regime ORDER BY t_end, run_id) AS rn FROM runs WHERE measured),
  sq AS (SELECT *, (t_end - lag(t_end) OVER (PARTITION BY regime ORDER BY rn))/3600.0::DOUBLE AS dt FROM fl),
  fw AS (SELECT regime, run_id, rn, t_end, y AS m, 1.0::DOUBLE AS p FROM sq WHERE rn = 1 UNION ALL
    SELECT s.regime, s.run_id, s.rn, s.t_end, rc.m + {_pp}/({_pp} + 1)*(s.y - rc.m), {_pp}*(1 - {_pp}/({_pp} + 1)) FROM fw rc JOIN sq s ON s.regime = rc.regime AND s.rn = rc.rn + 1),
  q AS (SELECT r.run_id, r.regime, r.t_end, (SELECT max(f.rn) FROM fl f WHERE f.regime = r.regime AND (f.t_end, f.run_id) < (r.t_end, r.run_id)) AS kp,
      (SELECT min(f.rn) FROM fl f WHERE f.regime = r.regime AND (f.t_end, f.run_id) > (r.t_end, r.run_id) AND f.t_end <= r.t_end + 18000) AS fs,
      (SELECT max(f.rn) FROM fl f WHERE f.regime = r.regime AND (f.t_end, f.run_id) > (r.t_end, r.run_id) AND f.t_end <= r.t_end + 18000) AS kc FROM runs r),
  bw AS (SELECT q.run_id, q.regime, q.fs, q.kc AS rn, f.y AS m, 1.0::DOUBLE AS p FROM q JOIN fl f ON f.regime = q.regime AND f.rn = q.kc UNION ALL
    SELECT rc.run_id, rc.regime, rc.fs, rc.rn - 1, rc.m + {_pp}/({_pp} + 1)*(e.y - rc.m), {_pp}*(1 - {_pp}/({_pp} + 1))
    FROM bw rc JOIN sq s ON s.regime = rc.regime AND s.rn = rc.rn JOIN sq e ON e.regime = rc.regime AND e.rn = rc.rn - 1 WHERE rc.rn > rc.fs),
  be AS (SELECT bw.run_id, bw.m, bw.p, f.t_end AS tf FROM bw JOIN fl f ON f.regime = bw.regime AND f.rn = bw.fs WHERE bw.rn = bw.fs),
  g AS (SELECT q.run_id, fw.m AS mf, fw.p + {QH}*(q.t_end - fw.t_end)/3600.0::DOUBLE + CASE WHEN (q.t_end - fw.t_end)/3600.0::DOUBLE > 0.25 THEN {QJ} ELSE 0 END AS pf,
      be.m AS mb, be.p + {QH}*(be.tf - q.t_end)/3600.0::DOUBLE + CASE WHEN (be.tf - q.t_end)/3600.0::DOUBLE > 0.25 THEN {QJ} ELSE 0 END AS pb
    FROM q LEFT JOIN fw ON fw.regime = q.regime AND fw.rn = q.kp LEFT JOIN be ON be.run_id = q.run_id),
  res AS (SELECT run_id, mf AS fwd, CASE WHEN pf IS NOT NULL AND pb IS NOT NULL THEN (mf/pf + mb/pb)/(1/pf + 1/pb) ELSE coalesce(mf, mb) END AS level,
    CASE WHEN pf IS NOT NULL AND pb IS NOT NULL THEN 1/(1/pf + 1/pb) ELSE coalesce(pf, pb) END AS level_var FROM g)"""


@query("fixed_lag_smoother", recursive(sql("runs", f"+{BACK_SQL}", "run_id", "fwd level level_var")))
def _(spark, sf):
    return smooth(spark, sf).select("run_id", "fwd", "level", "level_var")


# All noise ratios that are tried: variance an hour of pause, and a jump over a long one.
QH_GRID, QJ_GRID = [0.003, 0.01, 0.03, 0.1, 0.3, 1.0], [0.0, 0.1, 0.3, 1.0, 3.0]


@query("noise_ratio_selection")
def _(spark, sf):
    df = labels(spark, sf)
    return FL.select_noise(df.filter("t_end < 36000000"), df, ["regime"], "t_end", "run_id", "y", QH_GRID, QJ_GRID, 18000.0, regime_rows(spark, sf))


@query("noise_ratio_likelihood")
def _(spark, sf):
    ll = FL.likelihood_grid(labels(spark, sf), ["regime"], "t_end", "run_id", "y", QH_GRID, QJ_GRID, regime_rows(spark, sf))
    return ll.groupBy("regime").agg(F.max_by(F.struct("qh", "qj", "noise", "loglik", "n"), "loglik").alias("b")).select("regime", "b.*")


@query("smoothed_level_inner_folds")
def _(spark, sf):
    from ..operators.folds import inner_views, kfold
    q, c = inner_views(kfold(narrow(spark, sf, "t_start", "is_ref"), ["run_id"], 5), F.col("is_ref"), "fold", 5)
    x = FL.fixed_lag_smoother(q, c, ["regime", "view"], "t_start", "run_id", "y", QH, QJ, 3 * 86400.0, regime_rows(spark, sf))
    return x.select("run_id", "fwd", "level", F.log("level_var").alias("log_var"))


@query("trust_flags", sql("runs", f"""+{M}, {block_sql('h', 'b.t_end <= a.t_end - 3600', 'P_', 'b.t_end DESC, b.run_id DESC', (15,))},
  res AS (SELECT m.run_id, NOT duration > 150 AS no_active, coalesce(P_age1 > 8, true) AS stale, CASE WHEN pc IS NULL THEN abs(pa - pb)/2 > 3
     ELSE sqrt((pa*pa + pb*pb + pc*pc)/3 - pow((pa + pb + pc)/3, 2)) > 3 END AS disagree, coalesce(P_n, 0) < 30 AS cold
    FROM mem m LEFT JOIN h USING (run_id))""", "run_id no_active stale disagree cold"))
def _(spark, sf):
    df = members(runs(spark, sf))
    x = A.past_block(df, df.filter("measured"), ["regime"], NOLAG, rows=regime_rows(spark, sf))
    x = x.withColumn("act", F.col("duration") - 150)
    return FL.trust_flags(x, "act", "P_age1", "P_n", ["pa", "pb", "pc"]).select("run_id", "no_active", "stale", "disagree", "cold")
