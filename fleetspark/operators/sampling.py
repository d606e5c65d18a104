"""Row sampling with weights, time splits, fault rates and measurement policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_near, draw
from .ordered import Ordered, join_keys
from .quantiles import quantiles


def time_split(df: DataFrame, keys: list[str], t: str, q: float = 0.75, rows: int | None = None) -> DataFrame:
    """``is_val``: the row is at or after the key's ``q`` quantile of time; also adds ``boundary``."""
    cut = quantiles(df, keys, [t], {"b": q}, rows).withColumnRenamed(f"{t}_b", "boundary")
    return join_keys(df, cut, keys).withColumn("is_val", F.col(t) >= F.col("boundary"))


def thin(df: DataFrame, keys: list[str], t: str, tie: list[str], ttfs: list[str], ids: list[str], near_step: int = 2,
         far_frac: float = 0.02, seed: str = "far", rows: int | None = None) -> DataFrame:
    """Keep every ``near_step``-th row of those near a fault and a ``far_frac`` draw of the rest, with weights."""
    o = Ordered(df, keys, t, tie, rows).running({"_rn": ("count", F.lit(1))})
    near = any_near(ttfs)
    keep = (near & ((F.col("_rn") - 1) % near_step == 0)) | (~near & (draw(seed, *ids) < far_frac))
    weight = F.when(near, F.lit(float(near_step))).otherwise(F.lit(1.0 / far_frac))
    return o.with_df(o.df.filter(keep).withColumn("weight", weight)).result("_rn")


def fault_rates(events: DataFrame, keys: list[str], t: str, kind: str, kinds: list, until: DataFrame | None = None,
                bound: str = "boundary") -> DataFrame:
    """Distinct faults per day and kind; the span is at least one day. ``until`` limits each key to earlier events."""
    ev = events.select(*keys, t, kind).dropDuplicates()
    if until is not None:
        ev = join_keys(ev, until.select(*keys, bound), keys).filter(F.col(t) < F.col(bound))
    span = F.greatest((F.max(t) - F.min(t)) / 86400, F.lit(1.0))
    return ev.groupBy(*keys).agg(*[(F.count(F.when(F.col(kind) == k, 1)) / span).alias(f"rate_{k}") for k in kinds])


def fault_matrix(events: DataFrame, keys: list[str], t: str, kind: str, kinds: list) -> DataFrame:
    """Distinct faults per key, one zero-filled column per kind."""
    ev = events.select(*keys, t, kind).dropDuplicates()
    return ev.groupBy(*keys).agg(*[F.count(F.when(F.col(kind) == k, 1)).alias(f"fault_{k}") for k in kinds])


def ranked(df: DataFrame, keys: list[str], t: str, tie: list[str], out: str = "rank", newest_first: bool = False,
           rows: int | None = None) -> DataFrame:
    """1-based position of each row in its key."""
    return Ordered(df, keys, t, tie, rows).running({out: ("count", F.lit(1))}, reverse=newest_first).result()


def recent(df: DataFrame, keys: list[str], t: str, tie: list[str], n: int, rows: int | None = None) -> DataFrame:
    """The newest ``n`` rows per key."""
    return ranked(df, keys, t, tie, "_rank", True, rows).filter(F.col("_rank") <= n).drop("_rank")


def measure_random(df: DataFrame, ids: list[str], budget: float, seed: str = "measure") -> DataFrame:
    return df.withColumn("chosen", draw(seed, *ids) < budget)


def measure_periodic(df: DataFrame, keys: list[str], t: str, tie: list[str], budget: float,
                     rows: int | None = None) -> DataFrame:
    """One row in every ``round(1/budget)`` per key, starting with the first."""
    every = max(int(round(1 / budget)), 1)
    return ranked(df, keys, t, tie, "_rank", rows=rows).withColumn(
        "chosen", (F.col("_rank") - 1) % every == 0).drop("_rank")


def weighted_draw(df: DataFrame, keys: list[str], weight: str, ids: list[str], n: int, seed: str = "pick") -> DataFrame:
    """``n`` rows per key without replacement, probability proportional to weight (largest ``log(u)/w``)."""
    scored = df.withColumn("_u", F.log(F.greatest(draw(seed, *ids), F.lit(1e-12))) / F.col(weight))
    return ranked(scored, keys, "_u", ids, "_rank", True).filter(F.col("_rank") <= n).drop("_u", "_rank")
