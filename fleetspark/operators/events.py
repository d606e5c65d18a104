"""Row deltas, time since an event, excursions, and time to the next event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered
from .rolling import rolling_event_count, rolling_stats

NO_EVENT = 1e7  # seconds reported while an event has not happened yet


def row_delta(df: DataFrame, keys: list[str], t: str, tie: list[str], out: str = "dt", cap: float | None = None,
              rows: int | None = None) -> DataFrame:
    """Seconds since the previous row, 0 on the first one; optionally clipped to [0, cap]."""
    o = Ordered(df, keys, t, tie, rows).running({"_prev": ("lag", F.col(t))})
    gap = F.coalesce(F.col(t) - F.col("_prev"), F.lit(0.0))
    if cap is not None:
        gap = F.least(F.greatest(gap, F.lit(0.0)), F.lit(float(cap)))
    return o.with_df(o.df.withColumn(out, gap)).result("_prev")


def since(o: Ordered, conditions: dict[str, Column]) -> Ordered:
    """``since_{name}``: seconds since the condition last held, the current row included."""
    t = F.col(o.t)
    o = o.running({f"since_{n}": ("last", F.when(c, t)) for n, c in conditions.items()})
    return o.with_df(o.df.withColumns({f"since_{n}": F.coalesce(t - F.col(f"since_{n}"), F.lit(NO_EVENT))
                                       for n in conditions}))


def operating_state(df: DataFrame, keys: list[str], t: str, tie: list[str], change_cols: list[str],
                    gaps: dict[str, float], rows: int | None = None) -> DataFrame:
    """``dt``, ``since_{gap}`` per gap length, ``since_{col}_change`` per category column; the first row is a change."""
    o = Ordered(df, keys, t, tie, rows)
    o = o.running({"_prev": ("lag", F.struct(F.col(t).alias("_t"), *change_cols))})
    prev = F.col("_prev")
    o = o.with_df(o.df.withColumn("dt", F.coalesce(F.col(t) - prev["_t"], F.lit(0.0))))
    first = prev["_t"].isNull()
    conditions = {n: F.col("dt") > sec for n, sec in gaps.items()}
    conditions.update({f"{c}_change": first | ~F.col(c).eqNullSafe(prev[c]) for c in change_cols})
    return since(o, conditions).result("_prev")


def stop_counts(df: DataFrame, keys: list[str], t: str, tie: list[str], stops: dict[str, float], width: int,
                rows: int | None = None) -> DataFrame:
    """How many of the last ``width`` rows followed a data gap longer than each stop length; needs ``dt``."""
    flags = {f"stop_{n}": f"_f_{n}" for n in stops}
    df = df.withColumns({f"_f_{n}": F.col("dt") > sec for n, sec in stops.items()})
    return rolling_event_count(df, keys, t, tie, flags, {"window": width}, rows).drop(*flags.values())


def excursions(df: DataFrame, keys: list[str], t: str, tie: list[str], z_cols: dict[str, str], smooth: int,
               limit: float, widths: dict[str, int], rows: int | None = None) -> DataFrame:
    """Low/high excursion flags of short rolling z means, with time since and counts over row windows."""
    df = rolling_stats(df, keys, t, tie, [(c, "_zs", smooth) for c in z_cols.values()], ("mean",), rows)
    flags = {}
    for short, c in z_cols.items():
        mean = F.col(f"{c}_mean__zs")
        df = df.withColumns({f"{short}_low": F.coalesce(mean < -limit, F.lit(False)),
                             f"{short}_high": F.coalesce(mean > limit, F.lit(False))})
        flags.update({f"{short}_low": f"{short}_low", f"{short}_high": f"{short}_high"})
    df = df.drop(*[f"{c}_mean__zs" for c in z_cols.values()])
    o = since(Ordered(df, keys, t, tie, rows), {n: F.col(n) for n in flags})
    return rolling_event_count(o.result(), keys, t, tie, flags, widths, rows)


def time_to_next(rows_df: DataFrame, events: DataFrame, keys: list[str], t: str, tie: list[str], kind: str,
                 kinds: list, prefix: str = "ttf", rows: int | None = None) -> DataFrame:
    """``{prefix}_{kind}``: seconds to the next event of each kind (an event at the same time gives 0), null after the last."""
    left = rows_df.withColumns({"_event": F.lit(None).cast(events.schema[kind].dataType), "_side": F.lit(0)})
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows_df.schema if f.name not in [*keys, t]]
    right = events.select(*keys, F.col(t).cast(rows_df.schema[t].dataType).alias(t), *blank,
                          F.col(kind).alias("_event"), F.lit(1).alias("_side"))
    both = left.unionByName(right.select(*left.columns))
    o = Ordered(both, keys, t, ["_side", *tie], rows)
    o = o.running({f"{prefix}_{k}": ("last", F.when(F.col("_event") == k, F.col(t))) for k in kinds}, reverse=True)
    out = o.df.filter(F.col("_side") == 0)
    out = out.withColumns({f"{prefix}_{k}": F.col(f"{prefix}_{k}") - F.col(t) for k in kinds})
    return o.with_df(out).result("_event", "_side")
