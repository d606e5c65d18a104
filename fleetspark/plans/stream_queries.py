"""Streaming twins over the given tables as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import draw
from ..streaming import history as H
from ..streaming import jobs as J
from ..streaming import processors as P
from ..scratch import cut, new_path
from ..streaming.service import RefitService
from .registry import query
from .views import micros, sql, table


PIECES = 6


def event_columns(s):
    return s.select(F.col("user_id").alias("tool"), F.col("event_id").alias("id"), (micros("ts") / 1e6).alias("t"), F.timestamp_micros(micros("ts")).alias("at"),
                    F.col("value").alias("s1"), F.col("event_type").alias("recipe"))


def cut_by(df, c):
    """``PIECES`` parts of a table by equal spans of a number."""
    low, high = df.agg(F.min(c), F.max(c)).first()
    k = F.least(F.floor((c - F.lit(low)) * PIECES / F.lit(max(high - low, 1))), F.lit(PIECES - 1))
    return [df.filter(k == i) for i in range(PIECES)]


def closing(df, days):
    """Two rows far ahead in time, without a tool: they move the watermark past all real rows."""
    last = df.orderBy(F.desc("ts")).limit(1).withColumn("user_id", F.lit(None).cast(df.schema["user_id"].dataType))
    return [last.withColumn("ts", F.expr(f"ts + INTERVAL {days + k} DAYS")).withColumn("event_id", F.col("event_id") + 10**12 + k) for k in range(2)]


def over_events(spark, sf, make, swapped=True):
    """Stream over the events in time order, two neighbouring pieces swapped, then the closing rows."""
    df = table(spark, sf, "events")
    parts = cut_by(df, micros("ts"))
    if swapped:
        parts[1], parts[2] = parts[2], parts[1]
    return J.in_pieces(lambda s: make(event_columns(s)), J.Feed(spark, df.schema), [*parts, *closing(df, 400)]).filter("tool IS NOT NULL")


LATE = "40 days"


WCOLS = "s1_mean s1_std s1_min s1_max"


@query("stream_window_stats", sql("telemetry", """SELECT tool, CAST(floor(t/86400)*86400000000 AS BIGINT) AS start_us, count(*) AS n_samples, avg(s1) AS s1_mean, stddev_samp(s1) AS s1_std,
  min(s1) AS s1_min, max(s1) AS s1_max FROM telemetry GROUP BY ALL""", "tool start_us", WCOLS, "n_samples"))
def _(spark, sf):
    return over_events(spark, sf, lambda s: J.window_stats(s, "tool", "at", ["s1"], "1 day", late=LATE))


@query("stream_sliding_stats", sql("telemetry", """SELECT tool, CAST((floor(t/43200) - o)*43200000000 AS BIGINT) AS start_us, count(*) AS n_samples, avg(s1) AS s1_mean, stddev_samp(s1) AS s1_std,
  min(s1) AS s1_min, max(s1) AS s1_max FROM telemetry, range(0, 2) r(o) GROUP BY ALL""", "tool start_us", WCOLS, "n_samples"))
def _(spark, sf):
    return over_events(spark, sf, lambda s: J.window_stats(s, "tool", "at", ["s1"], "1 day", "12 hours", late=LATE))


@query("stream_sessions", sql("telemetry", """+a AS (SELECT *, coalesce(t - lag(t) OVER w >= 21600, true)::INT AS n FROM telemetry WINDOW w AS (PARTITION BY tool ORDER BY t, id)),
  b AS (SELECT *, sum(n) OVER (PARTITION BY tool ORDER BY t, id) AS s FROM a),
  res AS (SELECT tool, CAST(round(min(t)*1e6) AS BIGINT) AS start_us, CAST(round(max(t)*1e6) AS BIGINT) AS last_us, count(*) AS n FROM b GROUP BY tool, s)""", "tool start_us last_us", "", "n"))
def _(spark, sf):
    return over_events(spark, sf, lambda s: J.sessions(s, "tool", "at", "6 hours", late=LATE))


@query("stream_dedupe", sql("telemetry", "SELECT recipe, count(*) AS n FROM telemetry GROUP BY recipe", "recipe", "", "n"))
def _(spark, sf):
    df = table(spark, sf, "events")
    parts = cut_by(df, micros("ts"))
    # every piece comes twice, the second time after the next one
    order = [p for i, part in enumerate(parts) for p in ([part] if i == 0 else [part, parts[i - 1]])] + [parts[-1]]
    out = J.in_pieces(lambda s: J.deduplicated(event_columns(s), ["id"], "at", LATE), J.Feed(spark, df.schema), order)
    return out.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"))


@query("stream_time_since_event", sql("telemetry", """SELECT tool, id, coalesce(t - max(CASE WHEN recipe = 'error' THEN t END) OVER (PARTITION BY tool ORDER BY t, id), 1e7) AS since FROM telemetry""", "tool id", "since"))
def _(spark, sf):
    return over_events(spark, sf, lambda s: P.since_event(s.filter("tool IS NOT NULL").select("tool", "id", "t", (F.col("recipe") == "error").alias("flag"))), False)


def progress(spark, sf):
    """Records of a run of daily windows over the events, a file a micro-batch."""
    df = table(spark, sf, "events")
    feed = J.Feed(spark, df.schema)
    for part in cut_by(df, micros("ts")):
        feed.add(part)
    with J.ProgressLog(spark, new_path(spark, "progress")) as log:
        J.run_available(J.window_stats(event_columns(feed.stream()), "tool", "at", ["s1"], "1 day"), "append")
    return log.records().drop("query")


@query("stream_progress")
def _(spark, sf):
    return progress(spark, sf)


@query("stream_progress_rows", sql("", f"""+m AS (SELECT epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS low, max(epoch_us(ts)) OVER () AS high FROM events),
  res AS (SELECT least(floor((us - low)*{PIECES}/greatest(high - low, 1)), {PIECES - 1}) AS batch, count(*) AS input_rows FROM m GROUP BY 1)""", "", "", "batch input_rows"))
def _(spark, sf):
    return progress(spark, sf).filter("input_rows > 0").select("batch", "input_rows")


def run_columns(s):
    """The run view's columns on an orders stream."""
    d = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))")
    key = F.col("o_orderkey")
    grp = F.when(F.floor(key / 2) % 3 == 0, 1).otherwise(4)
    end = (d * 3600 + (key * 7919) % 3600 + 120 + F.col("o_custkey") % 300).cast("double")
    usage = ((d * 3) % 500 + F.col("o_custkey") % 3).cast("double")
    return s.select(key.alias("run_id"), F.concat(grp.cast("string"), F.when(key % 2 == 0, "A").otherwise("B")).alias("regime"), end.alias("t"),
                    (F.col("o_totalprice") / 1000).alias("y"), (usage / 100 - 4).alias("z"), F.floor(d * 3 / 500).cast("bigint").alias("life"),
                    (draw("m", "o_orderkey") < 0.7).alias("measured"), draw("policy", "o_orderkey").alias("u"))


def requests(df, delays):
    """Every run as a request at its end, and its label, if measured, at end + delay hours; once per scenario."""
    per = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(d * 3600.0).alias("delay")) for n, d in delays.items()])
    x = run_columns(df).withColumn("_s", F.explode(per)).select("*", "_s.scenario", "_s.delay").drop("_s")
    kinds = F.array(F.struct(F.lit(1).alias("kind"), F.col("t").alias("at")), F.struct(F.lit(0).alias("kind"), (F.col("t") + F.col("delay")).alias("at")))
    x = x.withColumn("_k", F.explode(kinds)).select("*", "_k.kind", "_k.at").drop("_k")
    return x.filter((F.col("kind") == 1) | F.col("measured")).select("scenario", "regime", "run_id", "kind", "at", "t", "y", "z", "life", "u")


def over_requests(spark, sf, delays, each=None, held_back=None, **options):
    """Stream over the requests and labels in order of arrival; ``held_back`` labels come one piece later than they should."""
    df = cut(requests(table(spark, sf, "orders"), delays))
    parts = cut_by(df, F.col("at"))
    if held_back is not None:
        parts = [p.filter(~held_back).unionByName(parts[i - 1].filter(held_back)) if i else p.filter(~held_back) for i, p in enumerate(parts)]
    make = (lambda s: s) if each else (lambda s: P.arrived_labels(s, **options))
    return J.in_pieces(make, J.Feed(spark, df.schema), parts, each)


PAIR_SQL = """SELECT run_id, t_end AS issued, CASE WHEN measured AND run_id % 10 <> 0 THEN y END AS y FROM runs"""


@query("stream_delayed_label_join", sql("runs", PAIR_SQL, "run_id", "issued y"))
def _(spark, sf):
    """Every prediction comes out, with the label that arrived within two hours or without one."""
    df = run_columns(table(spark, sf, "orders"))
    parts = cut_by(cut(df), F.col("t"))
    ahead = [df.orderBy(F.desc("t")).limit(1).withColumns({"t": F.col("t") + k * 1e7, "run_id": F.lit(-k).cast("long")}) for k in (1, 2, 3)]

    def join(s):
        s = s.withColumn("p_at", J.as_timestamp("t"))
        preds = s.select("run_id", F.col("t").alias("issued"), "p_at")
        late = F.when(F.col("run_id") % 10 == 0, 3 * 3600.0).otherwise(3600.0)
        labels = s.filter("measured OR run_id < 0").select("run_id", "y", F.timestamp_micros(((F.col("t") + late) * 1e6).cast("bigint")).alias("l_at"))
        return J.delayed_label_join(preds, labels, "run_id", "p_at", "l_at", "2 HOURS", "leftOuter")
    return J.in_pieces(join, J.Feed(spark, df.schema), [*parts, *ahead]).filter("run_id >= 0").select("run_id", "issued", "y")


HIST_SQL = """+h AS (SELECT a.run_id, count(*) AS n, avg(b.y) AS mean, max(b.y) FILTER (rk = 1) AS last1, avg(b.y) FILTER (rk <= 3) AS mean3, avg(b.y) FILTER (rk <= 10) AS mean10,
      count(*) FILTER (b.tb >= a.t_end - 86400) AS n24, max(a.t_end - b.tb) FILTER (rk = 1)/3600.0::DOUBLE AS age_h,
      sum(b.y * pow(0.5, (a.t_end - b.tb)/28800.0)) / sum(pow(0.5, (a.t_end - b.tb)/28800.0)) AS pred
    FROM runs a JOIN LATERAL (SELECT b.y, b.t_end AS tb, row_number() OVER (ORDER BY b.t_end DESC, b.y DESC) AS rk FROM runs b WHERE b.regime = a.regime AND b.measured AND {known} AND b.t_end + 3600 < a.t_end) b ON true GROUP BY a.run_id),
  res AS (SELECT r.regime, run_id, coalesce(n, 0) AS n, mean, last1, mean3, mean10, coalesce(n24, 0) AS n24, age_h, pred FROM runs r LEFT JOIN h USING (run_id))"""
HISTORY = "mean last1 mean3 mean10 age_h"


@query("stream_history_features", sql("runs", HIST_SQL.format(known="true"), "regime run_id", HISTORY, "n n24"))
def _(spark, sf):
    return over_requests(spark, sf, {"d1": 1.0}).filter("kind = 'run'").select("regime", "run_id", "n", "n24", *HISTORY.split())


WIDTH_SQL = HIST_SQL.format(known="true").replace("res AS", "g AS MATERIALIZED") + """,
  er AS (SELECT g.run_id, g.regime, r.t_end, abs(r.y - g.pred) AS e FROM g JOIN runs r USING (run_id) WHERE r.measured AND g.pred IS NOT NULL),
  wd AS (SELECT a.run_id, CASE WHEN count(*) >= 10 THEN 2*avg(e) END AS width FROM runs a JOIN er ON a.regime = er.regime AND er.t_end + 3600 < a.t_end GROUP BY a.run_id),
  res AS (SELECT g.*, width FROM g LEFT JOIN wd USING (run_id))"""


@query("stream_online_estimates", sql("runs", WIDTH_SQL, "regime run_id", "last1 age_h pred width"))
def _(spark, sf):
    """Estimates exist from the first known label on, their widths from the tenth error on."""
    return over_requests(spark, sf, {"d1": 1.0}).filter("kind = 'run'").select("regime", "run_id", "last1", "age_h", "pred", "width")


WAIT = 20 * 86400.0
DECAYS = {"e05": 1800, "e2": 7200, "e8": 28800, "e24": 86400}


def side_sql(name, regime, lead):
    """Count and decayed means of the labels known at each run, of one side."""
    fade = lambda s: f"pow(0.5, (a.t_end - b.t_end)/{s}.0::DOUBLE)"
    means = ", ".join(f"CASE WHEN sum({fade(s)}) > 1e-3 THEN sum(b.y*{fade(s)})/sum({fade(s)}) END AS {lead}{k}" for k, s in DECAYS.items())
    return f"""{name} AS (SELECT a.run_id, count(*) AS {lead}n, {means} FROM runs a JOIN runs b ON a.regime = {regime} AND b.measured AND b.t_end + 3600 < a.t_end GROUP BY a.run_id)"""


LIFE = "floor(floor({}.t_start/3600)*3/500)"
FULL_SQL = f"""{HIST_SQL.format(known="true").split("res AS")[0]}
  {side_sql("own", "b.regime", "")}, {side_sql("cross_side", "CAST(b.grp AS VARCHAR) || CASE WHEN b.stage = 'A' THEN 'B' ELSE 'A' END", "x_")},
  lf AS (SELECT a.run_id, count(*) AS life_n, avg(b.y) AS life_mean FROM runs a JOIN runs b ON a.regime = b.regime AND {LIFE.format("a")} = {LIFE.format("b")}
    AND b.measured AND b.t_end + 3600 < a.t_end GROUP BY a.run_id),
  pt AS (SELECT a.run_id, b.y AS partner_y, (b.t_end - a.t_end)/3600.0::DOUBLE AS partner_lag_h FROM runs a JOIN runs b ON a.wafer = b.wafer AND a.stage <> b.stage
    AND b.measured AND b.t_end + 3600 < a.t_end AND b.t_end + 3600 >= a.t_end - {WAIT}),
  res AS (SELECT r.regime, r.run_id, coalesce(h.n, 0) AS n, mean, last1, mean3, mean10, coalesce(n24, 0) AS n24, age_h, own.* EXCLUDE (run_id, n), coalesce(x_n, 0) AS x_n,
      cross_side.* EXCLUDE (run_id, x_n), coalesce(life_n, 0) AS life_n, life_mean, partner_y, partner_lag_h
    FROM runs r LEFT JOIN h USING (run_id) LEFT JOIN own USING (run_id) LEFT JOIN cross_side USING (run_id) LEFT JOIN lf USING (run_id) LEFT JOIN pt USING (run_id))"""
FULL = f"{HISTORY} {' '.join(DECAYS)} {' '.join('x_' + k for k in DECAYS)} life_mean partner_y partner_lag_h"


@query("stream_arrived_history", sql("runs", FULL_SQL, "regime run_id", FULL, "n n24 x_n life_n"))
def _(spark, sf):
    """Own, other stage, same life and same wafer; lives and wafers leave the state by timers during the run."""
    df = cut(requests(table(spark, sf, "orders"), {"d1": 1.0}).withColumn("wafer", F.floor(F.col("run_id") / 2).cast("bigint")))
    out = J.in_pieces(lambda s: H.arrived_history(s, WAIT), J.Feed(spark, df.schema), cut_by(df, F.col("at")))
    return out.select("regime", "run_id", "n", "n24", "x_n", "life_n", *FULL.split())


HASH_U = "CAST('0x' || substr(md5(concat_ws('_', b.run_id, 'policy')), 1, 8) AS BIGINT) / 4294967296.0"


@query("stream_measurement_decision", sql("runs", HIST_SQL.format(known=f"{HASH_U} < 0.2"), "regime run_id", HISTORY, "n n24"))
def _(spark, sf):
    """Only labels of the chosen fifth of the runs are learned."""
    out = over_requests(spark, sf, {"d1": 1.0}, policies={"d1": {"policy": "random", "budget": 0.2}})
    return out.filter("kind = 'run'").select("regime", "run_id", "n", "n24", *HISTORY.split())


LATE_SQL = f"""+e AS (SELECT regime, run_id, t_end AS tx, 1 AS kind FROM runs UNION ALL SELECT regime, run_id, t_end + 3600, 0 FROM runs WHERE measured),
  k AS (SELECT *, least(floor((tx - min(tx) OVER ())*{PIECES}/(max(tx) OVER () - min(tx) OVER ())), {PIECES - 1}) AS piece FROM e),
  g AS (SELECT l.regime, l.run_id, l.tx, (SELECT max(r.tx) FROM k r WHERE r.kind = 1 AND r.regime = l.regime AND r.piece <= l.piece) AS newest
    FROM k l WHERE l.kind = 0 AND l.run_id % 10 = 0 AND l.piece < {PIECES - 1}),
  res AS (SELECT regime, run_id, tx AS asked FROM g WHERE tx < newest - 7200)"""


@query("stream_late_labels", sql("runs", LATE_SQL, "regime run_id", "asked"))
def _(spark, sf):
    """Labels delivered a piece too late and more than two hours behind the newest request go to the side."""
    held = (F.col("kind") == 0) & (F.col("run_id") % 10 == 0)
    return over_requests(spark, sf, {"d1": 1.0}, held_back=held, lateness=7200.0).filter("kind = 'late'").select("regime", "run_id", F.col("at").alias("asked"))


@query("stream_online_service")
def _(spark, sf):
    service = RefitService(spark, ["z", "t"], "y")
    over_requests(spark, sf, {"d1": 1.0}, each=service)
    schema = requests(table(spark, sf, "orders"), {"d1": 1.0}).schema
    return service.scored(schema).select("run_id", "regime", "pred", "batch")
