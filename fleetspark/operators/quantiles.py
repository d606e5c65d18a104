"""Exact quantiles, medians and weighted quantiles that do not gather a hot group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import WHOLE, Ordered, join_keys, key_rows


def quantiles(df: DataFrame, keys: list[str], cols: list[str], qs: dict[str, float],
              rows: int | None = None) -> DataFrame:
    """One row per key with ``{col}_{name}`` = linearly interpolated quantile of the non-null values.

    Groups up to ``fleetspark.chunkRows`` use the built-in exact percentile; if any group is larger, values are
    counted, scanned in order and picked by rank, so no group has to fit in one task.
    """
    rows = key_rows(df, keys) if rows is None else rows
    if rows == WHOLE:
        probs = F.array(*[F.lit(float(q)) for q in qs.values()])
        out = df.groupBy(*keys).agg(*[F.percentile(c, probs).alias(f"_q_{c}") for c in cols])
        return out.select(*keys, *[F.col(f"_q_{c}")[i].alias(f"{c}_{n}") for c in cols for i, n in enumerate(qs)])
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_x"))
    long = long.select(*keys, F.col("_x.c").alias("_col"), F.col("_x.v").alias("_v")).filter(F.col("_v").isNotNull())
    counts = long.groupBy(*keys, "_col", "_v").agg(F.count(F.lit(1)).alias("_n"))
    group = [*keys, "_col"]
    o = Ordered(counts, group, "_v", rows=rows).running({"_cum": ("sum", F.col("_n"))})
    total = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    ranked = join_keys(o.result(), total, group)
    aggs = []
    for n, q in qs.items():
        pos = F.lit(float(q)) * (F.col("_total") - 1)
        pick = lambda k: F.min(F.when(F.col("_cum") > k, F.col("_v")))
        frac = F.max(pos - F.floor(pos))
        lo, hi = pick(F.floor(pos)), pick(F.ceil(pos))
        aggs.append((lo + (hi - lo) * frac).alias(n))
    picked = ranked.groupBy(*group).agg(*aggs)
    wide = picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_col") == c, F.col(n))).alias(f"{c}_{n}") for c in cols for n in qs])
    return join_keys(df.select(*keys).distinct(), wide, keys)  # a group without a value keeps its row, as above


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str = "wq",
                      rows: int | None = None) -> DataFrame:
    """First value whose cumulative weight reaches ``q`` of the total weight."""
    per_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    o = Ordered(per_value, keys, value, rows=rows).running({"_cum": ("sum", F.col("_w"))})
    total = per_value.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    return join_keys(o.result(), total, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("_cum") >= q * F.col("_total"), F.col(value))).alias(out))


def quantile_edges(df: DataFrame, keys: list[str], value: str, bins: int, out: str = "edges",
                   rows: int | None = None) -> DataFrame:
    """Distinct quantile edges of ``bins`` equal-frequency bins, as an ascending array per key."""
    qs = {f"q{i}": i / bins for i in range(bins + 1)}
    wide = quantiles(df, keys, [value], qs, rows)
    return wide.select(*keys, F.array_distinct(F.array(*[F.col(f"{value}_{n}") for n in qs])).alias(out))
