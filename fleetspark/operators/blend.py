"""Member blending: clip bounds, Gram matrices, non-negative weights, nested and walk-forward application.

Predictions are long: one row per (row id, member). A blend weight fit needs only the k x k Gram matrix of a group,
which Spark sums; the small non-negative solve then runs on one aggregated row per group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import join_keys


def clip_bounds(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))


def clip_members(df: DataFrame, bounds: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """Members cut to the key's label range; keys without a range are left alone, nulls stay null."""
    x = join_keys(df, bounds, keys)
    inside = lambda m: F.when(F.col("lo").isNull(), F.col(m)).when(
        F.col(m).isNotNull(), F.least(F.greatest(F.col(m), F.col("lo")), F.col("hi")))
    return x.withColumns({m: inside(m) for m in members}).drop("lo", "hi")


def gram(df: DataFrame, keys: list[str], members: list[str], y: str) -> DataFrame:
    """Per key: row count, upper-triangle ``g_i_j`` = sum of member products, ``b_i`` = sum of member x label."""
    ok = df.filter(" AND ".join(f"`{m}` IS NOT NULL" for m in [*members, y]))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(members):
        aggs.append(F.sum(F.col(a) * F.col(y)).alias(f"b_{i}"))
        aggs += [F.sum(F.col(a) * F.col(members[j])).alias(f"g_{i}_{j}") for j in range(i, len(members))]
    return ok.groupBy(*keys).agg(*aggs)


def solve_weights(G: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares on normal equations by active sets, scaled to sum one; uniform if all zero."""
    k = len(b)
    x, passive = np.zeros(k), np.zeros(k, bool)
    tol = 1e-10 * max(float(np.abs(b).max(initial=0.0)), 1.0)
    for _ in range(20 * k):
        slack = b - G @ x
        free = np.where(~passive, slack, -np.inf)
        if passive.all() or free.max() <= tol:
            break
        passive[int(free.argmax())] = True
        while True:
            s = np.zeros(k)
            s[passive] = np.linalg.lstsq(G[np.ix_(passive, passive)], b[passive], rcond=None)[0]
            bad = passive & (s <= 0)
            if not bad.any():
                x = s
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-14
            x[~passive] = 0.0
    return x / x.sum() if x.sum() > 0 else np.full(k, 1.0 / k)


def fit_weights(grams: DataFrame, keys: list[str], members: list[str], min_rows: int = 1,
                default: list[float] | None = None) -> DataFrame:
    """``weights`` array per key from Gram rows; ``default`` (or uniform) where rows are too few."""
    k = len(members)
    base = default or [1.0 / k] * k
    cols = [f"g_{i}_{j}" for i in range(k) for j in range(i, k)] + [f"b_{i}" for i in range(k)]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if not row["n"] or row["n"] < min_rows:
                    out.append(list(base))
                    continue
                G = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        G[i, j] = G[j, i] = row[f"g_{i}_{j}"]
                out.append(solve_weights(G, np.array([row[f"b_{i}"] for i in range(k)])).tolist())
            res = pdf[[*keys, "n"]].copy()
            res["weights"] = out
            yield res

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in grams.select(*keys, "n").schema] + ["weights array<double>"])
    return grams.select(*keys, "n", *cols).mapInPandas(solve, schema)


def combine(members: list[str], weights: Column) -> Column:
    """Weighted mean of the members present; missing members are dropped and the rest renormalised, falling back to their mean."""
    zero = F.lit(0.0)
    w = [F.when(F.col(m).isNotNull(), F.get(weights, F.lit(i))).otherwise(zero) for i, m in enumerate(members)]
    have = [F.when(F.col(m).isNotNull(), 1.0).otherwise(0.0) for m in members]
    v = [F.coalesce(F.col(m), zero) for m in members]
    total = lambda cs: sum(cs[1:], cs[0])
    sw, sh = total(w), total(have)
    return F.when(sw > 0, total([a * b for a, b in zip(w, v)]) / sw).when(sh > 0, total(v) / sh)


def apply_weights(df: DataFrame, weights: DataFrame, keys: list[str], members: list[str], out: str = "blend",
                  bounds: DataFrame | None = None) -> DataFrame:
    x = df if bounds is None else clip_members(df, bounds, keys, members)
    x = join_keys(x, weights.drop("n"), keys)
    return x.withColumn(out, combine(members, F.col("weights"))).drop("weights")


def nested_blend(df: DataFrame, fold: str, folds: int, group: list[str], members: list[str], y: str, out: str = "blend",
                 clip: bool = True) -> DataFrame:
    """Per outer fold: bounds and weights from the other folds, applied to the held-out rows; one plan for all folds."""
    views = F.filter(F.array(*[F.lit(i) for i in range(folds)]), lambda v: v != F.col(fold))
    train = df.withColumn("view", F.explode(views))
    held = df.withColumn("view", F.col(fold))
    keys = ["view", *group]
    if clip:
        bounds = clip_bounds(train, keys, y)
        train, held = clip_members(train, bounds, keys, members), clip_members(held, bounds, keys, members)
    weights = fit_weights(gram(train, keys, members, y), keys, members)
    return apply_weights(held, weights, keys, members, out).drop("view")


def bag_members(df: DataFrame, bags: dict[str, list[str]]) -> DataFrame:
    """Mean of the seed variants that are present."""
    return df.withColumns({b: combine(parts, F.array(*[F.lit(1.0)] * len(parts))) for b, parts in bags.items()})


def inverse_cube_weights(df: DataFrame, keys: list[str], members: list[str], y: str) -> DataFrame:
    """Weights proportional to 1 / MSE^3 over the rows given."""
    mse = df.groupBy(*keys).agg(*[F.avg((F.col(m) - F.col(y)) * (F.col(m) - F.col(y))).alias(m) for m in members])
    raw = [1.0 / F.pow(F.greatest(F.col(m), F.lit(1e-6)), F.lit(3.0)) for m in members]
    total = sum(raw[1:], raw[0])
    return mse.select(*keys, F.array(*[r / total for r in raw]).alias("weights"))


def local_mean_shrink(df: DataFrame, fold: str, folds: int, p: str, q_cols: dict[float, str], lams: list[float], y: str,
                      out: str = "shrunk") -> DataFrame:
    """(1-lam) p + lam q with (bandwidth, lam) chosen per fold on the other folds; ties go to the smaller pair.

    Squared error is quadratic in lam, so three sums per (fold, bandwidth) score every lam without replicating rows.
    """
    a, d = F.col(p) - F.col(y), lambda q: F.col(q) - F.col(p)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(a * a).alias("aa")]
    for i, q in enumerate(q_cols.values()):
        aggs += [F.sum(a * d(q)).alias(f"ad{i}"), F.sum(d(q) * d(q)).alias(f"dd{i}")]
    per = df.groupBy(fold).agg(*aggs)
    everything = Window.partitionBy()
    sums = [c for c in per.columns if c != fold]
    rest = per.select(fold, *[(F.sum(c).over(everything) - F.col(c)).alias(c) for c in sums])  # one row per fold
    trials = F.array(*[F.struct((F.round((F.col("aa") + 2 * lam * F.col(f"ad{i}") + lam * lam * F.col(f"dd{i}")) / F.col("n"), 12)).alias("mse"),
                                F.lit(float(h)).alias("h"), F.lit(float(lam)).alias("lam"))
                       for i, h in enumerate(q_cols) for lam in lams])
    pick = rest.select(fold, F.array_min(trials).alias("_best"))
    x = join_keys(df, pick, [fold])
    q = F.coalesce(*[F.when(F.col("_best.h") == float(h), F.col(c)) for h, c in q_cols.items()])
    return x.withColumns({"h": F.col("_best.h"), "lam": F.col("_best.lam")}).withColumn(
        out, (1 - F.col("lam")) * F.col(p) + F.col("lam") * q).drop("_best")


# -- walk-forward ---------------------------------------------------------------------------------
def refit_no(issue: str, step: float, t0: float = 0.0) -> Column:
    """Index k of the refit time ``T_k = t0 + k*step`` used for a prediction issued in ``(T_k, T_k + step]``."""
    return (F.ceil((F.col(issue) - t0) / step) - 1).cast("bigint")


def training_rows(df: DataFrame, group: list[str], ready: str, issue: str, usable: Column, step: float, t0: float) -> DataFrame:
    """Rows usable at every refit: count of usable rows with ``ready <= T_k`` per group, from daily counts."""
    k = refit_no(issue, step, t0)
    due = F.greatest(F.ceil((F.col(ready) - t0) / step), F.lit(0)).cast("bigint")  # first refit that may use the row
    return _cumulative(df.filter(usable).withColumn("_k", due), df.withColumn("_k", k), group,
                       {"n_train": F.count(F.lit(1))}, {"n_train": "sum"})


def _cumulative(source: DataFrame, targets: DataFrame, group: list[str], aggs: dict[str, Column], how: dict[str, str]) -> DataFrame:
    """Totals of ``source`` up to each refit index that ``targets`` uses; windows run on one row per (group, day)."""
    per = source.groupBy(*group, "_k").agg(*[c.alias(n) for n, c in aggs.items()])
    need = targets.select(*group, "_k").dropDuplicates()
    days = per.join(need, [*group, "_k"], "full_outer")
    w = Window.partitionBy(*group).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    cum = days.select(*group, "_k", *[getattr(F, how[n])(n).over(w).alias(n) for n in aggs])
    return cum.join(need, [*group, "_k"], "left_semi")


def walk_forward_blend(df: DataFrame, group: list[str], members: list[str], y: str, usable: Column, ready: str, issue: str,
                       arrive: str, step: float, t0: float, min_rows: int, default: list[float] | None = None,
                       out: str = "blend") -> DataFrame:
    """Each prediction uses weights fitted on rows ready by its refit time and is clipped to labels arrived by then.

    Gram entries are sums, so the fit at every refit is a running total of daily Gram rows.
    """
    k = len(members)
    due = lambda c: F.greatest(F.ceil((F.col(c) - t0) / step), F.lit(0)).cast("bigint")
    targets = df.withColumn("_k", refit_no(issue, step, t0))
    full = usable & F.expr(" AND ".join(f"`{m}` IS NOT NULL" for m in [*members, y]))
    aggs, how = {"n": F.count(F.lit(1))}, {"n": "sum"}
    for i in range(k):
        aggs[f"b_{i}"], how[f"b_{i}"] = F.sum(F.col(members[i]) * F.col(y)), "sum"
        for j in range(i, k):
            aggs[f"g_{i}_{j}"], how[f"g_{i}_{j}"] = F.sum(F.col(members[i]) * F.col(members[j])), "sum"
    grams = _cumulative(df.filter(full).withColumn("_k", due(ready)), targets, group, aggs, how)
    weights = fit_weights(grams.fillna(0, ["n"]), [*group, "_k"], members, min_rows, default)
    rng = _cumulative(df.filter(usable & F.col(y).isNotNull()).withColumn("_k", due(arrive)), targets, group,
                      {"lo": F.min(y), "hi": F.max(y)}, {"lo": "min", "hi": "max"})
    x = join_keys(join_keys(targets, weights.drop("n"), [*group, "_k"]), rng, [*group, "_k"])
    v = combine(members, F.col("weights"))
    cut = F.when(F.col("lo").isNull(), v).when(v.isNotNull(), F.least(F.greatest(v, F.col("lo")), F.col("hi")))
    return x.withColumn(out, cut).drop("weights", "lo", "hi", "_k")
