"""Tumbling numeric windows over telemetry, their labels and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_no(t: str, width: float) -> Column:
    return F.floor(F.col(t) / width).cast("bigint")


def last_value(c: str, order: Column) -> Column:
    """Last non-null value in order, as an aggregate."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), order))


def window_stats(df: DataFrame, keys: list[str], t: str, cols: list[str], width: float, order: Column | None = None,
                 trend_windows: int | None = None) -> DataFrame:
    """Per window: rows, last time, and mean/std/min/max/last of each column; optional trend against earlier windows.

    Partial aggregation does the work before the shuffle, so a hot key costs no more than any other.
    """
    order = F.col(t) if order is None else order
    aggs = [F.count(F.lit(1)).alias("n_samples"), F.max(t).alias(t)]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
                 F.max(c).alias(f"{c}_max"), last_value(c, order).alias(f"{c}_last")]
    out = df.groupBy(*keys, window_no(t, width).alias("window")).agg(*aggs)
    return add_trend(out, keys, cols, trend_windows) if trend_windows else out


def add_trend(stats: DataFrame, keys: list[str], cols: list[str], windows: int) -> DataFrame:
    """Mean minus the mean of the previous ``windows`` observed windows (the current one excluded).

    Runs on aggregated rows: a key has at most span/width of them, whatever its row count.
    """
    before = Window.partitionBy(*keys).orderBy("window").rowsBetween(-windows, -1)
    return stats.withColumns({f"{c}_trend": F.col(f"{c}_mean") - F.avg(f"{c}_mean").over(before) for c in cols})


def window_labels(df: DataFrame, keys: list[str], t: str, labels: list[str], width: float,
                  order: Column | None = None) -> DataFrame:
    order = F.col(t) if order is None else order
    return df.groupBy(*keys, window_no(t, width).alias("window")).agg(
        *[last_value(c, order).alias(c) for c in labels])


def training_table(features: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that have both features and labels."""
    return features.join(labels, [*keys, "window"], "inner")
