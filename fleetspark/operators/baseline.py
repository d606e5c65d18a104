"""Robust per-step baselines, z-scores, and the pressure-to-flow response curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import interp
from .ordered import join_keys
from .quantiles import quantile_edges, quantiles

IQR_TO_STD = 1.349
SCALE_SHARE, SCALE_FLOOR = 0.1, 1e-3
CURVE_BINS = 50


def step_stats(df: DataFrame, group: list[str], step: list[str], cols: list[str],
               rows: int | None = None) -> DataFrame:
    """Median and floored robust scale per (group, step), plus the group's global median and scale."""
    per_step = quantiles(df, [*group, *step], cols, {"med": 0.5, "q25": 0.25, "q75": 0.75}, rows)
    overall = global_stats(df, group, cols, rows)
    out = join_keys(per_step, overall, group)
    scale = {c: F.greatest((F.col(f"{c}_q75") - F.col(f"{c}_q25")) / IQR_TO_STD, F.col(f"{c}_floor")) for c in cols}
    return out.select(*group, *step, *[F.col(f"{c}_med") for c in cols],
                      *[scale[c].alias(f"{c}_scale") for c in cols])


def global_stats(df: DataFrame, group: list[str], cols: list[str],
               rows: int | None = None) -> DataFrame:
    """Global median, scale and scale floor per group; the fallback for unseen steps."""
    med = quantiles(df, group, cols, {"gmed": 0.5}, rows)
    std = df.groupBy(*group).agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in cols])
    out = join_keys(med, std, group)
    return out.select(*group, *[f"{c}_gmed" for c in cols],
                      *[F.greatest(F.col(f"_sd_{c}"), F.lit(SCALE_FLOOR)).alias(f"{c}_gscale") for c in cols],
                      *[F.greatest(SCALE_SHARE * F.col(f"_sd_{c}"), F.lit(SCALE_FLOOR)).alias(f"{c}_floor")
                        for c in cols])


def step_zscores(df: DataFrame, fit: DataFrame, group: list[str], step: list[str], cols: list[str],
               rows: int | None = None) -> DataFrame:
    """``{col}_z`` against the step baseline learned on ``fit``; steps unseen there use the group's global values.

    Both baselines are aggregates; adaptive execution broadcasts them when their measured size allows.
    """
    out = join_keys(df, step_stats(fit, group, step, cols, rows), [*group, *step])
    out = join_keys(out, global_stats(fit, group, cols, rows), group)
    z = {f"{c}_z": (F.col(c) - F.coalesce(F.col(f"{c}_med"), F.col(f"{c}_gmed")))
         / F.coalesce(F.col(f"{c}_scale"), F.col(f"{c}_gscale")) for c in cols}
    return out.withColumns(z).drop(*[f"{c}_{s}" for c in cols for s in ("med", "scale", "gmed", "gscale", "floor")])


def response_curve(df: DataFrame, keys: list[str], x: str, y: str, bins: int = CURVE_BINS,
                   rows: int | None = None) -> DataFrame:
    """Median x and median y per equal-frequency bin of x; one row per (key, bin)."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ok = join_keys(ok, quantile_edges(ok, keys, x, bins, rows=rows), keys)
    place = F.size(F.filter("edges", lambda e: e <= F.col(x))) - 1
    last = F.greatest(F.size("edges") - 2, F.lit(0))
    ok = ok.withColumn("bin", F.least(F.greatest(place, F.lit(0)), last)).drop("edges")
    return quantiles(ok, [*keys, "bin"], [x, y], {"med": 0.5}, rows)


def curve_residual(df: DataFrame, curve: DataFrame, keys: list[str], x: str, y: str, out: str = "resid") -> DataFrame:
    """y minus the clamped piecewise-linear curve at x; the curve is at most ``bins`` points per key."""
    pts = curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(f"{x}_med").alias("x"),
                                                                        F.col(f"{y}_med").alias("y")))).alias("_pts"))
    joined = join_keys(df, pts, keys)
    value = interp(F.col(x), F.col("_pts.x"), F.col("_pts.y"))
    return joined.withColumn(out, F.col(y) - value).drop("_pts")
