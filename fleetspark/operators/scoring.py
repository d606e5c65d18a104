"""Tool scores, error metrics, cost matrices and penalty-minimising decisions."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ACTION_LAST, ACTION_STEP, penalty_final, penalty_first, penalty_second, ttf_class
from .ordered import join_keys

PENALTIES = {"S1": penalty_first, "S2": penalty_second, "final": penalty_final}


def tool_scores(df: DataFrame, keys: list[str], penalties: list[Column], weight: Column | None = None,
                out: str = "score") -> DataFrame:
    """Weighted mean penalty over rows and penalty columns, per key."""
    total = penalties[0]
    for p in penalties[1:]:
        total = total + p
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys).agg(F.try_divide(F.sum(w * total), F.sum(w) * len(penalties)).alias(out))


def model_vs_null(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]], weight: str) -> DataFrame:
    """Summed tool scores of the answers and of answering null everywhere, one row per penalty."""
    aggs = []
    for name, fn in PENALTIES.items():
        for tag, pred in (("model", lambda p: F.col(p)), ("null", lambda p: F.lit(None).cast("double"))):
            parts = [fn(F.col(g), pred(p)) for g, p in pairs]
            total = parts[0]
            for p in parts[1:]:
                total = total + p
            aggs.append(F.try_divide(F.sum(F.col(weight) * total), F.sum(weight) * len(pairs)).alias(f"{name}_{tag}"))
    per_tool = df.groupBy(*keys).agg(*aggs)
    summed = per_tool.agg(*[F.sum(f"{n}_{t}").alias(f"{n}_{t}") for n in PENALTIES for t in ("model", "null")])
    return summed.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("penalty"), F.col(f"{n}_model").alias("model"), F.col(f"{n}_null").alias("all_null"))
        for n in PENALTIES])).alias("r")).select("r.*")


def action_grid(last: int = ACTION_LAST, step: int = ACTION_STEP) -> list[float | None]:
    """Answer candidates: null first, then a grid of seconds."""
    return [None, *[float(t) for t in range(0, last + 1, step)]]


def cost_matrix(df: DataFrame, ttf: str, weight: str, actions: list[float | None]) -> DataFrame:
    """Exact weighted mean penalty of every (true class, action): (``cls``, ``a``, ``action``, ``cost``).

    The answers must be evenly spaced, null first. For a label g and an answer a the penalty is a square and exp(-g/1000)|g - a|, so moments
    of the labels below and above a are all it takes. Labels are summed by class and cell of the grid, map-side first: one shuffle of at
    most classes x cells rows; prefix sums over the cells then give the cost of every answer.
    """
    grid = [float(a) for a in actions if a is not None]
    step = grid[1] - grid[0]
    if actions[0] is not None or any(abs(a - grid[0] - i * step) > 1e-9 for i, a in enumerate(grid)):
        raise ValueError("answers must be null and then evenly spaced")
    n, g, w = len(grid), F.col(ttf), F.col(weight)
    # Cell i holds labels from answer i to the next one; 0 those below all answers, the last those from the last answer on.
    cell = F.when(g.isNotNull(), F.least(F.greatest(F.floor((g - grid[0]) / step) + 1, F.lit(0)), F.lit(n))).cast("int")
    damp = w * F.exp(-g / 1000)
    known = w * F.when(g.isNotNull(), 1.0).otherwise(0.0)
    sums = {"w": w, "miss": w - known, "null": w * penalty_final(ttf, F.lit(None).cast("double")), "s0": known, "s1": known * g, "s2": known * g * g, "e0": damp, "e1": damp * g}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cells = df.groupBy(ttf_class(ttf).alias("cls"), cell.alias("_c")).agg(*[zero(F.sum(c)).alias(f"_{k}") for k, c in sums.items()])
    below = F.map_from_entries(F.collect_list(F.when(F.col("_c").isNotNull(), F.struct("_c", F.struct("_e0", "_e1").alias("e")))))
    per = cells.groupBy("cls").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums], below.alias("_m"))  # at most as many cells as answers in one row
    dense = per.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("_e", F.element_at("_m", F.col("a") - 1)).drop("_m")
    upto = Window.partitionBy("cls").orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    low0, low1 = F.sum(zero(F.col("_e._e0"))).over(upto), F.sum(zero(F.col("_e._e1"))).over(upto)
    x = F.get(F.array(*[F.lit(v).cast("double") for v in actions]), F.col("a"))
    first = x * (2 * low0 - F.col("_e0")) - (2 * low1 - F.col("_e1"))
    second = 0.1 * (F.col("_s2") - 2 * x * F.col("_s1") + x * x * F.col("_s0"))
    total = F.when(x.isNull(), F.col("_null")).otherwise((first + second) / 2 + F.col("_miss") * penalty_final(F.lit(None).cast("double"), x))
    return dense.select("cls", F.col("a").cast("long").alias("a"), x.alias("action"), F.try_divide(total, F.col("_w")).alias("cost"))


def cost_arrays(costs: DataFrame, classes: int) -> DataFrame:
    """The matrix as one row: ``actions`` and one array of costs per class (absent classes cost 0)."""
    per_class = costs.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("a", "action", "cost"))).alias("r"))
    wide = per_class.agg(F.map_from_entries(F.collect_list(F.struct("cls", "r"))).alias("m"))
    first = F.element_at(F.map_values("m"), 1)
    rows = [F.coalesce(F.transform(F.element_at("m", F.lit(k)), lambda x: x["cost"]),
                       F.transform(first, lambda x: F.lit(0.0))) for k in range(classes)]
    return wide.select(F.transform(first, lambda x: x["action"]).alias("actions"), F.array(*rows).alias("costs"))


def decide(df: DataFrame, proba: str, arrays: DataFrame, out: str = "answer") -> DataFrame:
    """Answer with the least expected cost per row; the first of equal ones wins, null comes first.

    The cost table has a fixed size (classes x actions), so it is read once and shipped with the function. One matrix
    product per Arrow batch replaces thousands of interpreted array steps per row.
    """
    table = arrays.head()
    costs, actions = np.array(table["costs"], float), np.array([np.nan if a is None else a for a in table["actions"]])

    @F.pandas_udf("double")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in batches:
            known = p.notna().to_numpy()
            best = np.full(len(p), np.nan)
            if known.any():
                best[known] = actions[np.round(np.stack(p[known].to_numpy()) @ costs, 9).argmin(axis=1)]
            yield pd.Series(best).astype(object).where(~np.isnan(best), None)

    return df.withColumn(out, answer(F.col(proba)))


def error_metrics(df: DataFrame, y: str, pred: str, group: str) -> DataFrame:
    """MAE, MSE, RMSE and null counts overall (group 'all') and per group, in one grouping-sets pass."""
    e = F.col(pred) - F.col(y)
    scored = df.withColumns({"_e": e, "_g": F.col(group).cast("string")})
    out = scored.groupingSets([[], ["_g"]], "_g").agg(
        F.grouping("_g").alias("_all"), F.avg(F.abs("_e")).alias("mae"), F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        F.count("_e").alias("n"), F.count(F.when(F.col(pred).isNull(), 1)).alias("n_null"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("_g")).alias(group), "mae", "mse",
                      F.sqrt("mse").alias("rmse"), "n", "n_null")


def score_report(df: DataFrame, y: str, pred: str, periods: dict[str, Column], dims: list[str],
                 fallback: Column | None = None) -> DataFrame:
    """MSE, counts, null and fallback counts by period and every subset of ``dims`` (null means all)."""
    tags = F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in periods.items()]), lambda x: x.isNotNull())
    long = df.withColumns({"period": F.explode(tags), "_e": F.col(pred) - F.col(y),
                           "_fb": F.lit(False) if fallback is None else fallback})
    sets = [[]]
    for d in dims:
        sets += [[*s, d] for s in sets]
    out = long.groupingSets([["period", *s] for s in sets], "period", *dims).agg(
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
        F.avg(F.col("_e") * F.col("_e")).alias("mse"), F.count("_e").alias("n"),
        F.count(F.when(F.col(pred).isNull(), 1)).alias("n_null"), F.count(F.when(F.col("_fb"), 1)).alias("n_fallback"))
    return out.select("period", *[F.when(F.col(f"_g_{d}") == 1, "all").otherwise(F.col(d)).alias(d) for d in dims],
                      "mse", "n", "n_null", "n_fallback")


def coverage(df: DataFrame, keys: list[str], y: str, pred: str, width: str) -> DataFrame:
    ok = df.filter(F.col(width).isNotNull())
    hit = F.when(F.abs(F.col(y) - F.col(pred)) <= F.col(width), 1.0).otherwise(0.0)
    return ok.groupBy(*keys).agg(F.avg(hit).alias("coverage"), F.avg(width).alias("mean_half_width"),
                                 F.count(F.lit(1)).alias("n"))


def control_error(df: DataFrame, keys: list[str], y: str, forecast: str) -> DataFrame:
    e = F.try_divide(y, forecast) - 1
    share = lambda lim: F.avg(F.when(F.abs(e) <= lim, 1.0).otherwise(0.0))
    ok = df.filter(F.col(forecast).isNotNull())
    return ok.groupBy(*keys).agg((F.sqrt(F.avg(e * e)) * 100).alias("rms_pct"), share(0.02).alias("within_2pct"),
                                 share(0.05).alias("within_5pct"), F.count(F.lit(1)).alias("n"))


def flag_table(df: DataFrame, flags: list[str], y: str, pred: str) -> DataFrame:
    """Per flag and for any flag: share of rows, MSE where flagged and where clear."""
    any_flag = F.exists(F.array(*flags), lambda x: x)
    e = (F.col(pred) - F.col(y)) * (F.col(pred) - F.col(y))
    items = [F.struct(F.lit(f).alias("flag"), F.col(f).alias("on")) for f in flags]
    items.append(F.struct(F.lit("any").alias("flag"), any_flag.alias("on")))
    long = df.select(e.alias("e"), F.explode(F.array(*items)).alias("f")).select("e", "f.*")
    return long.groupBy("flag").agg(
        F.avg(F.when(F.col("on"), 1.0).otherwise(0.0)).alias("share"), F.avg(F.when(F.col("on"), F.col("e"))).alias("mse_flagged"),
        F.avg(F.when(~F.col("on"), F.col("e"))).alias("mse_clear"), F.count(F.when(F.col("on"), 1)).alias("n"))


def leaderboard(long: DataFrame, candidate: str, y: str, pred: str, keys: list[str] = ()) -> DataFrame:
    """MSE per candidate and whether it is the best of its key (ties by name)."""
    e = F.col(pred) - F.col(y)
    scores = long.groupBy(*keys, candidate).agg(F.avg(e * e).alias("mse"), F.count(e).alias("n"))
    best = scores.groupBy(*keys).agg(F.min_by(candidate, F.struct("mse", candidate)).alias("best"))
    return join_keys(scores, best, list(keys)).withColumn("is_best", F.col(candidate) == F.col("best")).drop("best")
