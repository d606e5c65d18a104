"""Weighted detection curves, thresholds, lead-time recall, profiles and risk timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import range_counts
from .ordered import Ordered, join_keys
from .quantiles import weighted_quantile

ROC_POINTS = 80


def risk(proba, classes: int = 9) -> Column:
    """Sum of the first ``classes`` class probabilities."""
    return F.aggregate(F.slice(proba, 1, classes), F.lit(0.0), lambda a, v: a + v)


def score_curve(df: DataFrame, keys: list[str], pos: str, score: str, weight: str) -> DataFrame:
    """One row per distinct score, highest first: cumulative true/false positive weight, with totals ``P`` and ``N``."""
    w = F.col(weight)
    per = df.groupBy(*keys, score).agg(F.sum(F.when(F.col(pos), w).otherwise(0.0)).alias("_p"),
                                       F.sum(F.when(F.col(pos), 0.0).otherwise(w)).alias("_n"))
    o = Ordered(per, keys, score).running({"tp": ("sum", F.col("_p")), "fp": ("sum", F.col("_n"))}, reverse=True)
    total = per.groupBy(*keys).agg(F.sum("_p").alias("P"), F.sum("_n").alias("N"))
    return join_keys(o.result(), total, keys)


def curve_summary(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve, average precision and base rate; tied scores count as one step."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "_p", "_n"))
    area = F.try_divide(F.sum(n * (tp + tp - p) / 2), F.max("P") * F.max("N"))
    ap = F.try_divide(F.sum(F.when(p > 0, p * tp / (tp + fp)).otherwise(0.0)), F.max("P"))
    return curve.groupBy(*keys).agg(area.alias("auc"), ap.alias("ap"),
                                    F.try_divide(F.max("P"), F.max("P") + F.max("N")).alias("base_rate"))


def roc_points(curve: DataFrame, keys: list[str], points: int = ROC_POINTS) -> DataFrame:
    """ROC thinned to a grid of false-positive rates: the first point at or past each grid value, and the last one."""
    fpr, tpr = F.try_divide("fp", "N"), F.try_divide("tp", "P")
    before = F.try_divide(F.col("fp") - F.col("_n"), F.col("N"))
    crosses = F.floor(fpr * (points - 1)) > F.floor(before * (points - 1))
    last = (F.col("fp") == F.col("N")) & (F.col("tp") == F.col("P"))
    return curve.filter(crosses | last).select(*keys, fpr.alias("fpr"), tpr.alias("tpr"))


def threshold_report(df: DataFrame, keys: list[str], score: str, weight: str, ttf: str, fa_rate: float,
                     near: float, far: float, leads: list[float]) -> DataFrame:
    """Score threshold at a false-alarm rate on far rows, recall within ``near`` and by lead-time bin."""
    g = F.coalesce(F.col(ttf), F.lit(float("inf")))
    thr = weighted_quantile(df.filter(g >= far), keys, score, weight, 1 - fa_rate, "threshold")
    x = join_keys(df, thr, keys).withColumns({"_on": F.when(F.col(score) >= F.col("threshold"), 1.0).otherwise(0.0), "_g": g})
    w = F.col(weight)
    share = lambda cond: F.try_divide(F.sum(F.when(cond, w * F.col("_on"))), F.sum(F.when(cond, w)))
    aggs = [F.max("threshold").alias("threshold"), share(F.col("_g") < near).alias("recall")]
    for lo, hi in zip(leads[:-1], leads[1:]):
        aggs.append(share((F.col("_g") >= lo) & (F.col("_g") < hi)).alias(f"recall_{int(lo)}_{int(hi)}"))
    return x.groupBy(*keys).agg(*aggs)


def lead_profile(df: DataFrame, keys: list[str], ttf: str, weight: str, cols: list[str], edges: list[float],
                 far: float = 50000.0) -> DataFrame:
    """Mean deviation from the weighted far baseline per ``[a, b)`` bin of ``-ttf``."""
    from ..functions.scalars import bin_right_open
    g, w = F.col(ttf), F.col(weight)
    is_far = g.isNull() | (g > far)
    base = df.groupBy(*keys).agg(*[F.try_divide(F.sum(F.when(is_far & F.col(c).isNotNull(), w * F.col(c))),
                                               F.sum(F.when(is_far & F.col(c).isNotNull(), w))).alias(f"_b_{c}") for c in cols])
    x = join_keys(df.withColumn("bin", bin_right_open(-g, edges)).filter("bin is not null"), base, keys)
    return x.groupBy(*keys, "bin").agg(*[F.avg(F.col(c) - F.col(f"_b_{c}")).alias(f"{c}_dev") for c in cols],
                                       F.count(F.lit(1)).alias("n"))


def densest_window(events: DataFrame, keys: list[str], t: str, hours: float) -> DataFrame:
    """The key with most distinct event times and, in it, the start with most events in the next ``hours``."""
    ev = events.select(*keys, t).dropDuplicates()
    best = ev.groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(1)
    # limit 1 is the feature: one busiest key is reported
    mine = ev.join(F.broadcast(best.drop("count")), keys, "left_semi").withColumn("_at", F.col(t))
    n = range_counts(mine, keys, t, ["_at"], {"n": (0.0, True, hours * 3600, False)})
    top = n.orderBy(F.desc("n"), "_at").limit(1)
    return best.select(*keys).crossJoin(top).select(*keys, F.col("_at").alias("start"), "n")  # one row by one row


def downsample_max(df: DataFrame, keys: list[str], t: str, value: str, start, end, bins: int) -> DataFrame:
    """At most ``bins`` points over [start, end): mean time and maximum value per equal slice."""
    start, end = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, end))
    i = F.floor((F.col(t) - start) / ((end - start) / bins))
    inside = df.filter((F.col(t) >= start) & (F.col(t) < end))
    return inside.groupBy(*keys, i.alias("i")).agg(F.avg(F.col(t) - start).alias("t_mean"), F.max(value).alias("risk_max"))
