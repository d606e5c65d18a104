"""Deterministic folds, and fold views that keep a row's own fold out of its features in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import draw
from .ordered import join_keys
from .sampling import ranked

ALL_REFS = -1  # view that sees every reference row


def kfold(df: DataFrame, ids: list[str], k: int, seed: str = "fold", out: str = "fold") -> DataFrame:
    """Fold from a hash of the row's key: no shuffle, same result on every run."""
    return df.withColumn(out, F.floor(draw(seed, *ids) * k).cast("int"))


def balanced_kfold(df: DataFrame, ids: list[str], k: int, seed: str = "fold", out: str = "fold") -> DataFrame:
    """Folds whose sizes differ by at most one: position in hash order modulo ``k``."""
    x = ranked(df.withColumn("_u", draw(seed, *ids)), [], "_u", ids, "_rank")
    return x.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_u", "_rank")


def group_kfold(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """Whole groups per fold: groups are dealt out by size, largest first, in a snake over the folds."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked(sizes, [], "_n", [group], "_rank", newest_first=True)
    i = (F.col("_rank") - 1) % (2 * k)
    r = r.select(group, F.least(i, 2 * k - 1 - i).cast("int").alias(out))
    return join_keys(df, r, [group])


def inner_views(df: DataFrame, ref: Column, fold: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(queries, candidates) with a ``view`` key: references see other folds' references, other rows see all of them."""
    queries = df.withColumn("view", F.when(ref, F.col(fold)).otherwise(F.lit(ALL_REFS)))
    views = F.filter(F.array(F.lit(ALL_REFS), *[F.lit(i) for i in range(k)]), lambda v: v != F.col(fold))
    return queries, df.filter(ref).withColumn("view", F.explode(views))


def outer_views(df: DataFrame, ref: Column, fold: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(queries, candidates) for out-of-fold features: every row under every fold, references of the other folds."""
    folds = F.array(*[F.lit(i) for i in range(k)])
    queries = df.withColumn("view", F.explode(folds))
    return queries, df.filter(ref).withColumn("view", F.explode(F.filter(folds, lambda v: v != F.col(fold))))
