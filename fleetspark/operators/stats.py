"""Wear curves, fixed-effects slopes, rank correlation, before/after tests and column profiles."""

from __future__ import annotations

import math

import pandas as pd
import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_left_open
from ..scratch import cut
from .asof import asof
from .ordered import Ordered, join_keys
from .quantiles import quantile_edges, quantiles


def wear_curve(df: DataFrame, keys: list[str], x: str, y: str, bins: int = 8, rows: int | None = None) -> DataFrame:
    """Equal-frequency bins ``(a, b]`` (lowest included) of x: median x, mean, deviation and count of y."""
    e = join_keys(df.filter(F.col(x).isNotNull()), quantile_edges(df, keys, x, bins, rows=rows), keys)
    place = F.greatest(F.size(F.filter("edges", lambda v: v < F.col(x))) - 1, F.lit(0))
    b = e.withColumn("bin", place).drop("edges")
    med = quantiles(b, [*keys, "bin"], [x], {"med": 0.5}, rows)
    agg = b.groupBy(*keys, "bin").agg(F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_sd"), F.count(F.lit(1)).alias("n"))
    return join_keys(agg, med, [*keys, "bin"])


def deviation_curve(df: DataFrame, keys: list[str], life: str, x: str, y: str, edges: list[float]) -> DataFrame:
    """Mean deviation from the life's mean per fixed ``(a, b]`` bin of x."""
    mean = df.groupBy(*keys, life).agg(F.avg(y).alias("_m"))
    d = join_keys(df, mean, [*keys, life]).withColumn("bin", bin_left_open(x, edges)).filter("bin is not null")
    return d.groupBy(*keys, "bin").agg(F.avg(F.col(y) - F.col("_m")).alias("dev"), F.count(F.lit(1)).alias("n"))


def within_life_slope(df: DataFrame, keys: list[str], life: str, x: str, y: str, per: float = 100.0) -> DataFrame:
    """OLS slope per ``per`` units with one intercept per life, and its standard error, from per-life sums."""
    u, v = F.col(x) / per, F.col(y)
    g = df.groupBy(*keys, life).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(u, v).alias("_c"), F.var_pop(u).alias("_xx"), F.var_pop(v).alias("_yy"))
    s = g.groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("lives"), F.sum(F.col("n") * F.col("_c")).alias("sxy"),
                             F.sum(F.col("n") * F.col("_xx")).alias("sxx"), F.sum(F.col("n") * F.col("_yy")).alias("syy"))
    b = F.try_divide("sxy", "sxx")
    rss = F.col("syy") - b * F.col("sxy")
    # Residuals have mean zero, so their variance with df = lives + 1 removed is rss / (n - lives - 1).
    return s.select(*keys, b.alias("slope"), F.sqrt(F.try_divide(F.try_divide(rss, F.col("n") - F.col("lives") - 1), F.col("sxx"))).alias("se"), "n", "lives")


def variation(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.try_divide(F.stddev_samp(c), F.avg(c)) * 100).alias(f"cv_{c}") for c in cols], F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Ranks with ties averaged, from counts of distinct values, so ties cost nothing extra."""
    per = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_k"))
    o = Ordered(per, keys, col).running({"_cum": ("sum", F.col("_k"))})
    r = o.result().select(*keys, col, (F.col("_cum") - (F.col("_k") - 1) / 2).alias(out))
    return join_keys(df, r, [*keys, col])


def rank_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    x = average_ranks(average_ranks(df, keys, a, "_ra"), keys, b, "_rb")
    return x.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def resets(df: DataFrame, keys: list[str], t: str, tie: list[str], counter: str, drop: Column | float, rows: int | None = None) -> DataFrame:
    """Rows right after the counter fell by more than ``drop``."""
    o = Ordered(df, keys, t, tie, rows).running({"_prev": ("lag", F.col(counter))})
    return o.result().filter(F.col("_prev") - F.col(counter) > drop).drop("_prev")


def before_after(df: DataFrame, events: DataFrame, keys: list[str], t: str, tie: list[str], y: str, n: int = 20,
                 rows: int | None = None) -> DataFrame:
    """Welch comparison of the last ``n`` rows before and the first ``n`` at or after each event, per key and event time."""
    # Rows are numbered once; an event needs the number of rows before it and then meets 2 n numbers, not lists kept for every row.
    o = Ordered(df.select(*keys, t, *tie, y), keys, t, tie, rows).running({"_rn": ("count", F.lit(1))})
    R = cut(o.result().select(*keys, t, F.col(y).alias("y"), "_rn"))  # read for the lookup and for the values
    x = asof(events.select(*keys, F.col(t).alias("event_t")).dropDuplicates(), R, keys, payload={"rn": F.col("_rn")}, out="_b", side="prev",
             lt=F.col("event_t"), rt=F.col(t), rtie=F.col("_rn"), rows=rows)
    x = x.select(*keys, "event_t", F.coalesce("_b.rn", F.lit(0)).alias("_nb"))
    near = x.withColumn("_rn", F.explode(F.sequence(F.greatest(F.col("_nb") - n + 1, F.lit(1)), F.col("_nb") + n)))
    near = join_keys(near, R.select(*keys, "_rn", "y"), [*keys, "_rn"], "inner")
    lists = lambda side: F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("_rn", "y")))), lambda s: s["y"])
    near = near.groupBy(*keys, "event_t").agg(lists(F.col("_rn") <= F.col("_nb")).alias("_vb"), lists(F.col("_rn") > F.col("_nb")).alias("_va"))
    x = join_keys(x, near, [*keys, "event_t"])
    some = lambda v: F.when(F.size(v) > 0, F.col(v))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, q: a + q) / F.size(v)
    x = x.withColumns({"_vb": some("_vb"), "_va": some("_va")}).withColumns({"before": mean(F.col("_vb")), "after": mean(F.col("_va"))})
    var = lambda v, m: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, q: a + (q - F.col(m)) * (q - F.col(m))), F.size(v) - 1)
    x = x.withColumns({"_sb": var(F.col("_vb"), "before") / F.size("_vb"), "_sa": var(F.col("_va"), "after") / F.size("_va")})
    se2 = F.col("_sb") + F.col("_sa")
    ok = (F.size("_vb") > 1) & (F.size("_va") > 1) & (se2 > 0)
    dof = se2 * se2 / (F.col("_sb") * F.col("_sb") / (F.size("_vb") - 1) + F.col("_sa") * F.col("_sa") / (F.size("_va") - 1))
    return x.select(*keys, "event_t", "before", "after", (F.col("after") - F.col("before")).alias("jump"),
                    F.when(ok, (F.col("after") - F.col("before")) / F.sqrt(se2)).alias("t_stat"), F.when(ok, dof).alias("dof"))


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d)
            c = 1 + num / c
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * f


def with_p_value(df: DataFrame, t_stat: str = "t_stat", dof: str = "dof") -> DataFrame:
    """Two-sided Student p-value; one row per event, so the helper sees little data."""
    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else _beta_tail(b / (b + a * a), b / 2, 0.5) for a, b in zip(t, n)], dtype="float64")
    return df.withColumn("p_value", p_value(F.col(t_stat), F.col(dof)))


def nearest_offset(events: DataFrame, others: DataFrame, keys: list[str], t: str, rows: int | None = None) -> DataFrame:
    """Signed time from each event to the closest one of another kind (the earlier wins a tie)."""
    at = dict(lt=F.col(t), rt=F.col(t), rows=rows)
    x = asof(events.select(*keys, t), others, keys, payload={"t": F.col(t)}, out="_p", inclusive=True, **at)
    x = asof(x, others, keys, payload={"t": F.col(t)}, out="_n", side="next", **at)
    back, ahead = F.col("_p.t") - F.col(t), F.col("_n.t") - F.col(t)
    return x.select(*keys, t, F.when(ahead.isNull() | (F.abs(back) <= ahead), back).otherwise(ahead).alias("offset"))


def naive_baselines(df: DataFrame, keys: list[str], y: str, ref: Column) -> DataFrame:
    """Mean and median label of the reference rows, joined to every row of the key."""
    mean = df.filter(ref).groupBy(*keys).agg(F.avg(y).alias("base_mean"))
    med = quantiles(df.filter(ref), keys, [y], {"m": 0.5}).withColumnRenamed(f"{y}_m", "base_median")
    return join_keys(join_keys(df, mean, keys), med, keys)


# -- column profiles --------------------------------------------------------------------------------
def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: non-null share, mean and population deviation, from a single aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols)
                                                    for n, f in (("k", F.count), ("m", F.avg), ("s", F.stddev_pop))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"k_{i}") / F.col("_n")).alias("share"),
                                                   F.col(f"m_{i}").alias("mean"), F.col(f"s_{i}").alias("sd"))
                                          for i, c in enumerate(cols)])).alias("r")).select("r.*")


def correlations(df: DataFrame, cols: list[str], prof: DataFrame) -> DataFrame:
    """Long table (a, b, corr) over pairs in column order with nulls replaced by the column mean.

    The values are one vector column, centred first, so that one pass of sums of products gives the whole matrix; the driver sees
    columns x columns numbers.
    """
    means = {r["column"]: r["mean"] for r in prof.collect()}  # one row per column
    centred = df.select(*[(F.coalesce(F.col(c).cast("double"), F.lit(means[c])) - F.lit(means[c])).alias(f"z{i}") for i, c in enumerate(cols)])
    vectors = VectorAssembler(inputCols=[f"z{i}" for i in range(len(cols))], outputCol="v").transform(centred).select("v")
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    pairs = [(cols[i], cols[j], None if np.isnan(matrix[i, j]) else float(matrix[i, j])) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return df.sparkSession.createDataFrame(pairs, "a string, b string, corr double")


def prune_columns(df: DataFrame, cols: list[str], base: list[str] = (), min_share: float = 0.05, max_corr: float = 0.98) -> list[str]:
    """Columns kept after dropping sparse, constant and near-duplicate ones (against ``base`` and earlier columns).

    The data stays distributed; the driver sees one row per column and one per column pair.
    """
    every = [*base, *cols]
    prof = profile(df, every)
    ok = {r["column"] for r in prof.collect() if r["share"] >= min_share and r["sd"] is not None and r["sd"] > 1e-9}
    live = [c for c in every if c in ok]
    high = {(r["a"], r["b"]) for r in correlations(df, live, prof).filter(F.abs("corr") > max_corr).collect()}
    kept: list[str] = []
    for c in live:
        if c in base:
            continue
        if not any((o, c) in high or (c, o) in high for o in [*base, *kept]):
            kept.append(c)
    return kept


def missing_patterns(df: DataFrame, cols: list[str], ids: list[str]) -> DataFrame:
    """Null count per column and the first column with the same null pattern (one indicator per pattern is enough).

    A pattern is the xor of the hashes of the rows where the column is null, so it is one aggregate.
    """
    h = F.xxhash64(*ids)
    row = df.agg(*[f.alias(n) for i, c in enumerate(cols) for n, f in (
        (f"x{i}", F.bit_xor(F.when(F.col(c).isNull(), h))), (f"k{i}", F.count(F.when(F.col(c).isNull(), 1))))])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.col(f"x{i}").alias("sig"), F.col(f"k{i}").alias("nulls"))
                                          for i, c in enumerate(cols)])).alias("r")).select("r.*")
    first = long.groupBy("sig", "nulls").agg(F.min_by("column", "pos").alias("same_as"))
    return join_keys(long, first, ["sig", "nulls"]).select("column", "nulls", "same_as")
