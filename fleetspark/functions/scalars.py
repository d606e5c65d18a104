"""Scalar column functions: penalties, bins, draws, interpolation, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time-to-failure class edges in seconds, and the grid of numeric answers.
TTF_EDGES = [0, 30, 60, 120, 240, 480, 900, 1500, 2400, 3600, 5400, 7200, 10800]
FAR_CLASS = 12
NEAR_SEC = 10800
NORMAL_SEC = 50000
ACTION_LAST, ACTION_STEP = 7200, 20


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def int_or_minus_one(c) -> Column:
    """Category code that never fails: unparsable or missing becomes -1."""
    return F.coalesce(col(c).try_cast("bigint"), F.lit(-1).cast("bigint"))


def clip(c, lo, hi) -> Column:
    """Clip that keeps nulls (least/greatest alone would skip them)."""
    c = col(c)
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def penalty_first(gt, pred) -> Column:
    gt, pred = col(gt), col(pred)
    return (F.when(gt.isNull() & pred.isNull(), F.lit(0.0))
            .when(gt.isNull(), F.exp(-0.001 * pred) * pred)
            .when(pred.isNull(), F.exp(-0.001 * gt) * gt)
            .otherwise(F.exp(-0.001 * gt) * F.abs(gt - pred)))


def penalty_second(gt, pred) -> Column:
    gt, pred = col(gt), col(pred)
    return (F.when(gt.isNull() & pred.isNull(), F.lit(0.0))
            .when(gt.isNull(), 5.0 / (F.abs(pred) + 3))
            .when(pred.isNull(), 20 * F.exp(-1.0 / (F.abs(gt) + 0.1)))
            .otherwise(0.1 * (gt - pred) * (gt - pred)))


def penalty_final(gt, pred) -> Column:
    return (penalty_first(gt, pred) + penalty_second(gt, pred)) / 2


def bin_right_open(c, edges: list) -> Column:
    """Index of the ``[a, b)`` bin; null outside the edges."""
    c = col(c)
    out = F.when(c < edges[0], F.lit(None))
    for i, hi in enumerate(edges[1:]):
        out = out.when(c < hi, F.lit(i))
    return out.cast("int")


def bin_left_open(c, edges: list) -> Column:
    """Index of the ``(a, b]`` bin; null outside the edges."""
    c = col(c)
    out = F.when(c <= edges[0], F.lit(None))
    for i, hi in enumerate(edges[1:]):
        out = out.when(c <= hi, F.lit(i))
    return out.cast("int")


def ttf_class(ttf) -> Column:
    return F.coalesce(bin_right_open(ttf, TTF_EDGES), F.lit(FAR_CLASS))


def any_near(ttfs: list, sec: float = NEAR_SEC) -> Column:
    return F.exists(F.array(*[col(c) for c in ttfs]), lambda x: F.coalesce(x < sec, F.lit(False)))


def all_far(ttfs: list, sec: float = NORMAL_SEC) -> Column:
    return F.forall(F.array(*[col(c) for c in ttfs]), lambda x: F.coalesce(x >= sec, F.lit(True)))


def draw(seed: str, *cols) -> Column:
    """Uniform [0, 1) draw that depends only on the row's key and the seed."""
    text = F.concat_ws("_", *[col(c).cast("string") for c in cols], F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def interp(x, xs: Column, ys: Column) -> Column:
    """Piecewise-linear interpolation over ascending ``xs``, clamped at both ends."""
    x = col(x)
    n = F.size(xs)
    i = F.size(F.filter(xs, lambda v: v <= x))
    at = lambda a, k: F.element_at(a, F.greatest(k, F.lit(1)).cast("int"))
    x0, x1 = at(xs, i), at(xs, F.least(i + 1, n))
    y0, y1 = at(ys, i), at(ys, F.least(i + 1, n))
    inner = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return F.when(x.isNotNull() & (n > 0),
                  F.when(i == 0, at(ys, F.lit(1))).when(i >= n, at(ys, n)).otherwise(inner))


def best_action(proba, costs: Column, actions: Column) -> Column:
    """Action with the least expected cost; ``costs`` holds one array over actions per class, the first minimum wins."""
    proba = col(proba)
    expected = F.transform(
        F.sequence(F.lit(1), F.size(actions)),
        lambda a: F.aggregate(F.zip_with(proba, costs, lambda p, row: p * F.element_at(row, a)),
                              F.lit(0.0), lambda acc, v: acc + v))
    return F.element_at(actions, F.array_position(expected, F.array_min(expected)).cast("int"))


def select_by(columns: list[str], prefixes=(), suffixes=(), exclude=()) -> list[str]:
    """Column names by prefix or suffix, minus an exclusion set; order is kept."""
    return [c for c in columns if c not in set(exclude)
            and (not prefixes or c.startswith(tuple(prefixes))) and (not suffixes or c.endswith(tuple(suffixes)))]
