"""Per-run tables: annotation, summaries, dose integrals, step columns and physics aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import WHOLE, Ordered, join_keys

STEPS = (0, 1, 2)
MAX_DT = 5.0  # a longer pause between rows counts as this many seconds
OUTLIER = 1000.0


@dataclass(frozen=True)
class RunColumns:
    """Which columns play which part in a run's sensor rows."""
    key: str = "run_id"
    t: str = "ts"
    seq: list[str] = field(default_factory=list)
    pressure: str = "pressure"
    zones: list[str] = field(default_factory=list)
    flows: list[str] = field(default_factory=list)
    head: str = "head"
    stage: str = "rot"
    water: str = "dw"
    usage: list[str] = field(default_factory=list)


def annotate(rows: DataFrame, c: RunColumns, chamber: str, active: Column, bound: int | None = None) -> DataFrame:
    """``grp`` (1 or 4 from the run's lowest chamber), ``step`` 0..2 and ``active``. Runs that fit in one slice are dealt by run once."""
    if bound == WHOLE:
        out = rows.withColumn("_low", F.min(chamber).over(Window.partitionBy(c.key)))
    else:
        out = join_keys(rows, rows.groupBy(c.key).agg(F.min(chamber).alias("_low")), [c.key])
    out = out.withColumn("grp", F.when(F.col("_low") <= 3, 1).otherwise(4))
    step = F.least(F.greatest(F.col(chamber) - F.col("grp"), F.lit(0)), F.lit(2)).cast("int")
    return out.withColumns({"step": step, "active": active}).drop("_low")


def with_dt(rows: DataFrame, c: RunColumns, keys: list[str] | None = None, extra: list[str] = (),
            bound: int | None = None) -> DataFrame:
    """``dt``: clipped seconds since the previous row of the run; ``_prev`` holds that row's values."""
    o = Ordered(rows, keys or [c.key], c.t, c.seq, bound).running({"_prev": ("lag", F.struct(c.t, *extra))})
    gap = F.least(F.greatest(F.coalesce(F.col(c.t) - F.col(f"_prev.{c.t}"), F.lit(0.0)), F.lit(0.0)), F.lit(MAX_DT))
    return o.with_df(o.df.withColumn("dt", gap)).result()


def run_summary(rows: DataFrame, c: RunColumns, bound: int | None = None) -> DataFrame:
    """Start, duration, row counts, usage counters and pressure x rotation doses, one row per run."""
    act = F.col("active")
    aggs = [F.min("grp").alias("grp"), F.min(c.t).alias("t_start"), (F.max(c.t) - F.min(c.t)).alias("duration"),
            F.count(F.lit(1)).alias("n_rows"), F.count(F.when(act, 1)).alias("active_sec")]
    for u in c.usage:
        aggs += [F.min(u).alias(f"{u}_start"), (F.max(u) - F.min(u)).alias(f"{u}_delta")]
    for p in [c.pressure, *c.zones]:
        for r in (c.head, c.stage):
            aggs.append(F.sum(F.col(p) * F.col(r) * F.col("dt")).alias(f"pv_{p}_{r}"))
    return with_dt(rows, c, bound=bound).groupBy(c.key).agg(*aggs)


def step_columns(rows: DataFrame, keys: list[str], cols: list[str], std_cols: list[str] = ()) -> DataFrame:
    """Mean, deviation and row count of active rows per step as fixed ``_s0.._s2`` columns."""
    on = lambda s: F.col("active") & (F.col("step") == s)
    aggs = [F.avg(F.when(on(s), F.col(c))).alias(f"{c}_s{s}_mean") for c in cols for s in STEPS]
    aggs += [F.stddev_samp(F.when(on(s), F.col(c))).alias(f"{c}_s{s}_std") for c in std_cols for s in STEPS]
    n = lambda s: F.count(F.when(on(s), 1))
    aggs += [F.when(n(s) > 0, n(s)).alias(f"active_sec_s{s}") for s in STEPS]
    return rows.groupBy(*keys).agg(*aggs)


def physics(rows: DataFrame, c: RunColumns, bound: int | None = None) -> DataFrame:
    """Relative speed, pressure distribution, slurry and timing aggregates in one pass over the rows."""
    x = with_dt(rows, c, bound=bound)
    col = F.col
    act = col("active")
    p, head, stage, dt = col(c.pressure), col(c.head), col(c.stage), col("dt")
    floor = lambda v, lo: F.greatest(v, F.lit(lo))
    zone_mean = sum((col(z) for z in c.zones), F.lit(0.0)) / len(c.zones)
    zone_var = sum(((col(z) - zone_mean) * (col(z) - zone_mean) for z in c.zones), F.lit(0.0)) / len(c.zones)
    flow = sum((col(f) for f in c.flows), F.lit(0.0))
    v_rel, v_sum = F.abs(head - stage), head + stage
    rows_of = {
        "v_rel_mean": v_rel, "v_sum_mean": v_sum, "rot_on_mean": F.when(stage > 0, 1.0).otherwise(0.0),
        **{f"{z}_ratio": col(z) / floor(p, 1e-3) for z in c.zones},
        "zone_cv": F.sqrt(zone_var) / floor(zone_mean, 1e-3), "sommerfeld": v_sum * flow / floor(p, 1e-3),
        "water_frac_active": col(c.water).cast("double"), "p_all_mean": p + sum((col(z) for z in c.zones), F.lit(0.0)),
    }
    sums = {"v_rel_int": v_rel * dt, "v_sum_int": v_sum * dt, "pv_rel": p * v_rel * dt, "pv_sum": p * v_sum * dt,
            "pv_rot_int": F.when(stage > 0, p * v_sum * dt).otherwise(0.0), "rot_sec": F.when(stage > 0, dt).otherwise(0.0),
            "p_int": p * dt, "flow_vol": flow * dt, "pv_head": p * head * dt, "_sec": dt}
    per_step = {"v_rel": v_rel, "zone_cv": rows_of["zone_cv"], "sommerfeld": rows_of["sommerfeld"]}
    aggs = [F.avg(F.when(act, v)).alias(n) for n, v in rows_of.items()]
    aggs += [F.sum(F.when(act, v)).alias(n) for n, v in sums.items()]
    aggs += [F.avg(F.when(act & (col("step") == s), v)).alias(f"{n}_s{s}") for n, v in per_step.items() for s in STEPS]
    aggs += [F.sum(F.when(act & (col("step") == s), p * dt)).alias(f"p_int_s{s}") for s in STEPS]
    aggs += [F.sum(flow * dt).alias("flow_vol_all"), F.sum(F.when(~act, flow * dt)).alias("flow_vol_idle"),
             F.avg(col(c.water)).alias("water_frac_all"), F.avg(F.when(~act, col(c.water))).alias("water_frac_idle"),
             F.sum(col(c.water) * dt).alias("water_sec"), F.count(F.lit(1)).alias("rows_all"),
             (F.min(F.when(act, col(c.t))) - F.min(c.t)).alias("lead_sec"), (F.max(c.t) - F.max(F.when(act, col(c.t)))).alias("tail_sec"),
             F.count(F.when((p > 0) & ~act, 1)).alias("pressed_idle_rows"),
             (F.stddev_samp(F.when(act, p)) / floor(F.avg(F.when(act, p)), 1e-3)).alias("p_cv"),
             F.max(col(c.t) - col(f"_prev.{c.t}")).alias("gap_max")]
    aggs += [F.count(F.when(col("step") == s, 1)).alias(f"rows_s{s}") for s in STEPS]
    out = x.groupBy(c.key).agg(*aggs)
    safe = lambda a, b: F.when(b != 0, a / b)
    return out.withColumns({"vol_per_sec": safe(col("flow_vol"), col("_sec")),
                            "vol_per_pv": safe(col("flow_vol"), col("pv_head")) * 1e4}).drop("_sec")


def life_ids(df: DataFrame, keys: list[str], t: str, tie: list[str], counter: str, drop: float, out: str = "life",
             bound: int | None = None) -> DataFrame:
    """Number of counter resets (falls by more than ``drop``) so far in each key."""
    o = Ordered(df, keys, t, tie, bound).running({"_prev": ("lag", F.col(counter))})
    reset = F.when(F.col(counter) - F.col("_prev") < -drop, 1).otherwise(0)
    return o.running({out: ("sum", reset)}).result("_prev")


def life_position(df: DataFrame, keys: list[str], t: str, tie: list[str], counter: str, life: str = "life",
                  bound: int | None = None) -> DataFrame:
    """Hours, rows and fraction of the life's highest count since the last reset."""
    group = [*keys, life]
    ends = df.groupBy(*group).agg(F.min(t).alias("_t0"), F.max(counter).alias("_top"))
    o = Ordered(df, group, t, tie, bound).running({f"{life}_rows": ("count", F.lit(1))})
    out = join_keys(o.result(), ends, group)
    return out.withColumns({f"{life}_rows": F.col(f"{life}_rows") - 1, f"{life}_hours": (F.col(t) - F.col("_t0")) / 3600.0,
                            f"{life}_frac": F.col(counter) / F.greatest(F.col("_top"), F.lit(1.0))}).drop("_t0", "_top")


def schedule(df: DataFrame, keys: list[str], t: str, t_end: str, tie: list[str], idle: float = 1800.0, lot: float = 600.0,
             bound: int | None = None) -> DataFrame:
    """Gaps to neighbours, idle periods and lots, with position and length inside each of them."""
    o = Ordered(df, keys, t, tie, bound)
    o = o.running({"_p": ("lag", F.struct(F.col(t).alias("t"))), "prev_end": ("max", F.col(t_end)), "_rn": ("count", F.lit(1))}, inclusive=False)
    gap = F.col(t) - F.col("_p.t")
    gap_end = F.col(t) - F.col("prev_end")
    idle_long = F.coalesce(gap_end > idle, F.lit(True))
    new_lot = F.coalesce(gap > lot, F.lit(True))
    o = o.with_df(o.df.withColumns({"gap_prev": gap, "gap_prev_end": gap_end, "log_gap_prev": F.log1p(F.greatest(gap, F.lit(0.0))),
                                    "idle_long": idle_long, "_lot": new_lot}).drop("_p", "prev_end"))
    o.tie = [*o.tie, "_rn"]  # equal rows keep one order in all scans
    # A spell or lot starts where its flag is set: its number, place and length come from the row numbers of its start and of the next one.
    starts = {"spell": F.col("idle_long"), "lot": F.col("_lot")}
    o = o.running({**{n: ("sum", F.when(f, 1).otherwise(0)) for n, f in starts.items()}, **{f"_{n}0": ("last", F.when(f, F.col("_rn"))) for n, f in starts.items()},
                   "_idle_t": ("last", F.when(F.col("idle_long"), F.col(t)))})
    o = o.running({"_n": ("lag", F.col(t)), "_left": ("count", F.lit(1)), **{f"_{n}1": ("last", F.when(f, F.col("_rn"))) for n, f in starts.items()}},
                  reverse=True, inclusive=False)
    end = F.col("_rn") + 1 + F.col("_left")
    out = o.df.withColumns({"gap_next": F.col("_n") - F.col(t), "hours_since_idle": (F.col(t) - F.col("_idle_t")) / 3600.0,
                            **{f"{n}_pos": F.col("_rn") - F.col(f"_{n}0") for n in starts},
                            **{f"{n}_len": F.coalesce(F.col(f"_{n}1"), end) - F.col(f"_{n}0") for n in starts}})
    return o.with_df(out).result("_rn", "_left", "_n", "_lot", "_idle_t", *[f"_{n}{i}" for n in starts for i in (0, 1)])


def partner_lookup(df: DataFrame, wafer: str, stage: str, ref: Column, payload: dict[str, Column]) -> DataFrame:
    """Values of the same wafer's other stage, where that row is a reference."""
    other = df.filter(ref).select(F.col(wafer).alias("_w"), F.col(stage).alias("_s"),
                                  *[v.alias(n) for n, v in payload.items()])
    flip = F.when(F.col(stage) == "A", "B").otherwise("A")
    return df.join(other, (F.col(wafer) == F.col("_w")) & (flip == F.col("_s")), "left").drop("_w", "_s")
