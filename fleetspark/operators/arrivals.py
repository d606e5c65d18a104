"""Features from labels that had arrived when a prediction was issued: past, look-ahead, kernels, fallbacks.

A run ends at ``t``; its label arrives at ``t + delay`` if it was measured; its prediction is issued at ``t + lag``.
So a label is visible when it ended by ``c = t + lag - delay``. Labels before the run in stream order ``(t, tie)`` are
its past, later ones its look-ahead. Prefix states on the label rows and as-of lookups replace pairwise joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import cut
from .asof import asof, mean_of, range_counts, recent_lists
from .neighbors import GAUSS_REACH, HOUR, MIN_WEIGHT, MOMENTS, ewm_states, line_estimate, line_of_sums, line_sums
from .ordered import Ordered, join_keys

EWM_HOURS = {"ewmh05": 0.5, "ewmh2": 2.0, "ewmh8": 8.0, "ewmh24": 24.0}
EWM_COUNTS = {"ewmn2": 2.0, "ewmn5": 5.0, "ewmn15": 15.0}
LATE = 2 ** 62  # tie value after every real one
DENSE_TIMES = 400.0  # distinct times in a reach beyond which moments of cells are cheaper than the times themselves
NEAR = 6.0  # widths to the nearest label up to which a place meets the labels of its block
BLOCK_WIDTHS = 32.0  # widths of a block of places, besides a margin of labels on both sides
KERNEL_DROP = 82.0  # twice the exponent at which a weight relative to the nearest label's is below 2e-18


@dataclass(frozen=True)
class Clock:
    t: str = "t_end"
    tie: str = "run_id"
    y: str = "y"
    delay: float = 3600.0
    lag: float = 0.0

    @property
    def cutoff(self) -> Column:
        return F.col(self.t) + F.lit(self.lag - self.delay)

    @property
    def looks_ahead(self) -> bool:
        return self.lag >= self.delay


def clock_columns(df: DataFrame, k: Clock) -> DataFrame:
    """Arrival, issue and ready times, and the label a model may read."""
    arrive, issue = F.col(k.t) + k.delay, F.col(k.t) + k.lag
    return df.withColumns({"arrive": arrive, "issue": issue, "ready": F.greatest(arrive, issue),
                           "ym": F.when(F.col("measured"), F.col(k.y))})


def _past(queries: DataFrame, labels: DataFrame, keys: list[str], k: Clock, payload: dict[str, Column], out: str,
          rows: int | None) -> DataFrame:
    """Last visible label before the row."""
    if k.looks_ahead:
        lt, ltie = F.col(k.t), F.col(k.tie)
    else:
        lt, ltie = k.cutoff, F.lit(LATE)
    return asof(queries, labels, keys, lt, F.col(k.t), payload, out, "prev", ltie=ltie, rtie=F.col(k.tie),
                by_position=True, rows=rows)


def label_states(labels: DataFrame, keys: list[str], k: Clock, back: int, ahead: int, rows: int | None, decays: bool = True) -> DataFrame:
    """Running count and sum, recent lists and decayed sums on the label rows."""
    o = Ordered(labels, keys, k.t, [k.tie], rows).running({"_n": ("count", F.lit(1)), "_sum": ("sum", F.col(k.y))})
    out = o.result()
    if decays:
        out = ewm_states(out, keys, k.t, [k.tie], k.y, {n: h * HOUR for n, h in EWM_HOURS.items()}, EWM_COUNTS, rows)
    return recent_lists(out, keys, k.t, [k.tie], {"t": F.col(k.t), "y": F.col(k.y), "id": F.col(k.tie)}, back, ahead, rows)


def past_block(queries: DataFrame, labels: DataFrame, keys: list[str], k: Clock, prefix: str = "P_",
               rows: int | None = None, only: list[str] | None = None) -> DataFrame:
    """Count, last, means of 3/10/all, age, labels in 24 h, decayed means and trends of the visible past.

    ``only`` names the columns that are made, all by default; states and lists that no column needs are neither made nor carried.
    """
    asked = lambda *names: only is None or any(f"{prefix}{n}" in only for n in names)
    decayed = [n for n in [*EWM_HOURS, *EWM_COUNTS] if asked(n)]
    trends = [n for n in (15, 40) if asked(f"trend{n}")]
    states = label_states(labels, keys, k, max([10, *trends]), 0, rows, bool(decayed))
    newest = F.reverse("_back")
    pay = {"t": F.col(k.t), "n": F.col("_n"), "sum": F.col("_sum"), "last1": F.get(newest, F.lit(0))["y"],
           "mean3": mean_of(newest, "y", 3), "mean10": mean_of(newest, "y", 10),
           **{f"l{n}": line_sums(newest, n, F.col(k.t)) for n in trends}, **{f"{a}_{n}": F.col(f"{a}_{n}") for n in decayed for a in ("s", "w")}}
    out = _past(queries, states, keys, k, pay, "_h", rows)
    age = (F.col(k.t) - F.col("_h.t")) / HOUR
    cols = {"n": F.coalesce(F.col("_h.n"), F.lit(0)), "last1": F.col("_h.last1"), "mean3": F.col("_h.mean3"), "mean10": F.col("_h.mean10"),
            "mean_all": F.col("_h.sum") / F.col("_h.n"), "age1": age}
    if asked("n24"):
        day = range_counts(queries, keys, k.t, [k.tie], {"_old": (-1e18, True, -24 * HOUR, True)}, source=labels, rows=rows)
        out = join_keys(out, day, [k.tie])
        cols["n24"] = F.when(F.col("_h.n").isNotNull(), F.greatest(F.col("_h.n") - F.col("_old"), F.lit(0)))
    for n in decayed:
        decay = F.pow(F.lit(0.5), age / EWM_HOURS[n]) if n in EWM_HOURS else F.lit(1.0)
        w = F.col(f"_h.w_{n}")
        cols[n] = F.when(w * decay > MIN_WEIGHT, F.col(f"_h.s_{n}") / w)
    for n in trends:
        cols[f"trend{n}"] = line_of_sums(F.col(f"_h.l{n}"), age, least=5)[0]
    return out.withColumns({f"{prefix}{n}": c for n, c in cols.items() if asked(n)}).drop("_h", "_old")


def life_block(queries: DataFrame, labels: DataFrame, keys: list[str], k: Clock, life: str, prefix: str = "P_",
               rows: int | None = None) -> DataFrame:
    """Mean and count of the visible past labels of the same life."""
    group = [*keys, life]
    o = Ordered(labels, group, k.t, [k.tie], rows).running({"_n": ("count", F.lit(1)), "_sum": ("sum", F.col(k.y))})
    out = _past(queries, o.result(), group, k, {"n": F.col("_n"), "sum": F.col("_sum")}, "_l", rows)
    return out.withColumns({f"{prefix}life_mean": F.col("_l.sum") / F.col("_l.n"),
                            f"{prefix}life_n": F.coalesce(F.col("_l.n"), F.lit(0))}).drop("_l")


def ahead_block(queries: DataFrame, labels: DataFrame, keys: list[str], k: Clock, prefix: str = "F_",
                rows: int | None = None) -> DataFrame:
    """Count, next, means, lead, labels in 24 h, decayed means and trend of labels after the row that arrived by issue."""
    if not k.looks_ahead:
        raise ValueError("labels after the row can only be visible when lag >= delay")
    neg = lambda c: (-F.col(c).cast("double"))
    rev = labels.withColumns({"_x": neg(k.t), "_xt": (-F.col(k.tie)).cast("bigint")})
    o = Ordered(rev, keys, "_x", ["_xt"], rows).running({"_rank": ("count", F.lit(1))})
    R = ewm_states(o.result(), keys, "_x", ["_xt"], k.y, {n: h * HOUR for n, h in EWM_HOURS.items()}, EWM_COUNTS, rows)
    R = recent_lists(R, keys, k.t, [k.tie], {"t": F.col(k.t), "y": F.col(k.y)}, 0, 15, rows)
    names = [*EWM_HOURS, *EWM_COUNTS]
    pay = {"t": F.col(k.t), "rank": F.col("_rank"), "l": F.col("_ahead"), **{f"{a}_{n}": F.col(f"{a}_{n}") for n in names for a in ("s", "w")}}
    # The first label after the row, and the first one past the cutoff: their decayed sums differ by the window's.
    out = asof(queries, R, keys, F.col(k.t), F.col(k.t), pay, "_a", "next", ltie=F.col(k.tie), rtie=F.col(k.tie), by_position=True, rows=rows)
    cut = {n: v for n, v in pay.items() if n != "l"}
    out = asof(out, R, keys, k.cutoff, F.col(k.t), cut, "_z", "next", ltie=F.lit(LATE), rtie=F.col(k.tie), by_position=True, rows=rows)
    out = out.withColumn("_c", k.cutoff)
    l = F.filter("_a.l", lambda s: s["t"] <= F.col("_c"))
    n = F.coalesce(F.col("_a.rank"), F.lit(0)) - F.coalesce(F.col("_z.rank"), F.lit(0))
    day = F.least(F.lit(24 * HOUR), F.lit(k.lag - k.delay))
    upto = range_counts(queries, keys, k.t, [k.tie], {"_d": (-1e18, True, 24 * HOUR, False), "_e": (-1e18, True, k.lag - k.delay, True)},
                        source=labels, rows=rows)
    out = join_keys(out, upto, [k.tie])
    has = n > 0
    # Labels with lead < 24 h: all look-ahead labels minus those at or past 24 h.
    n24 = n - F.greatest(F.col("_e") - F.col("_d"), F.lit(0))
    cols = {f"{prefix}n": n, f"{prefix}next1": F.get(l, F.lit(0))["y"], f"{prefix}mean3": mean_of(l, "y", 3),
            f"{prefix}mean10": mean_of(l, "y", 10), f"{prefix}age1": (F.get(l, F.lit(0))["t"] - F.col(k.t)) / HOUR,
            f"{prefix}n24": F.when(has, n24), f"{prefix}trend15": line_estimate(l, 15, F.col(k.t), least=5)[0]}
    for name in names:
        if name in EWM_HOURS:
            d = lambda side: F.pow(F.lit(0.5), (F.col(f"{side}.t") - F.col(k.t)) / HOUR / EWM_HOURS[name])
        else:
            d = lambda side: F.lit(1.0) if side == "_a" else F.pow(F.lit(0.5), n / EWM_COUNTS[name])
        part = lambda a: F.col(f"_a.{a}_{name}") * d("_a") - F.coalesce(F.col(f"_z.{a}_{name}") * d("_z"), F.lit(0.0))
        cols[f"{prefix}{name}"] = F.when(has & (part("w") > MIN_WEIGHT), part("s") / part("w"))
    return out.withColumns(cols).drop("_a", "_z", "_c", "_d", "_e")


def two_sided(queries: DataFrame, labels: DataFrame, keys: list[str], k: Clock, widths: tuple[float, ...] = (0.25, 1.0, 4.0),
              rows: int | None = None, dense_times: float = DENSE_TIMES) -> DataFrame:
    """Nearest visible labels (NN1, NN3), bracket interpolation (INT) and Gaussian kernel means on both sides.

    Kernel weights are relative to the nearest label's, so a row far from all labels still has a mean. A kernel meets the distinct
    times in its reach where they are at most ``dense_times`` on average, else moments of cells. Both are exact; only the work differs.
    """
    item = {"t": F.col(k.t), "y": F.col(k.y)}
    R = recent_lists(labels, keys, k.t, [k.tie], item, 3, 3, rows)
    out = _past(queries, R, keys, k, {"l": F.reverse("_back")}, "_p", rows)
    if k.looks_ahead:
        out = asof(out, R, keys, F.col(k.t), F.col(k.t), {"l": F.col("_ahead")}, "_f", "next", ltie=F.col(k.tie), rtie=F.col(k.tie),
                   by_position=True, rows=rows)
        out = out.withColumn("_c", k.cutoff).withColumn("_fl", F.filter("_f.l", lambda s: s["t"] <= F.col("_c"))).drop("_f")
    else:
        out = out.withColumns({"_c": k.cutoff, "_fl": F.filter("_p.l", lambda s: F.lit(False))})
    none = F.array().cast(out.select("_fl").schema[0].dataType)
    out = out.withColumns({"_pl": F.coalesce("_p.l", none), "_fl": F.coalesce("_fl", none)}).drop("_p")
    mark = lambda c, side: F.transform(c, lambda s, i: F.struct(F.abs(s["t"] - F.col(k.t)).alias("d"), F.lit(side).alias("s"),
                                                                F.when(F.lit(side == 0), -i).otherwise(i).alias("i"), s["y"].alias("y")))
    near = F.sort_array(F.concat(mark("_pl", 0), mark("_fl", 1)))
    p, f, t = F.get("_pl", F.lit(0)), F.get("_fl", F.lit(0)), F.col(k.t)
    bracket = p["y"] + (f["y"] - p["y"]) * (t - p["t"]) / F.greatest(f["t"] - p["t"], F.lit(1e-9 * HOUR))
    out = out.withColumns({"NN1": F.get(near, F.lit(0))["y"], "NN3": mean_of(near, "y", 3),
                           "INT": F.coalesce(bracket, p["y"], f["y"]), "_tp": p["t"], "_tf": f["t"]}).drop("_pl", "_fl")
    out = cut(out)  # read for its rows and for the places of each kernel
    dense = {}
    for h in widths:
        name = f"K{h:g}".replace(".", "")
        if _times_in_reach(labels, keys, k, h) > dense_times:
            dense[name] = h
        else:
            out = _kernel_of_times(out, labels, keys, k, h, name)
    if dense:
        out = _kernels_of_blocks(out, labels, keys, k, dense, rows)
    return out.drop("_tp", "_tf", "_c")


def _times_in_reach(labels: DataFrame, keys: list[str], k: Clock, h: float) -> float:
    """Distinct label times that the average label shares a span of one reach with."""
    times = labels.select(*keys, F.col(k.t).alias("_tc")).dropDuplicates()
    spans = times.groupBy(*keys, F.floor(F.col("_tc") / (GAUSS_REACH * h * HOUR)).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return spans.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).head()[0] or 0.0  # one number


def _kernels_of_blocks(out: DataFrame, labels: DataFrame, keys: list[str], k: Clock, widths: dict[str, float], rows: int | None = None) -> DataFrame:
    """``_kernels_of_cells`` with the rows and labels of a block of time in one task.

    A row crosses the network once with all widths, a label about twice. Running sums of moments about the centres of cells of half a
    width give the labels of a cell up to the cutoff, and those before and after the row's own time. Rows whose nearest label is more
    than ``NEAR`` of the smallest widths away are left to ``_kernels_of_cells``.
    """
    d0 = F.least(F.abs(F.col(k.t) - F.col("_tp")), F.abs(F.col("_tf") - F.col(k.t)))
    is_far = F.coalesce(d0 > NEAR * min(widths.values()) * HOUR, F.lit(False))
    names, cells = list(widths), int(2 * (NEAR**2 + KERNEL_DROP) ** 0.5) + 1
    wide, size = max(widths.values()) * HOUR, MOMENTS + 1
    block, part = lambda c: F.floor(c / (BLOCK_WIDTHS * wide)), [*keys, "_blk"]
    margin = (cells + 1) / 2 * wide
    Q = out.filter(~is_far).select(*keys, block(F.col(k.t)).alias("_blk"), F.col(k.t).cast("double").alias("_p"), F.col("_c").cast("double").alias("_cut"), d0.cast("double").alias("_d0"),
                                   F.when(F.col("measured"), 1.0).otherwise(0.0).alias("_mine"), F.coalesce(F.col(k.y).cast("double"), F.lit(0.0)).alias("_own"), F.struct(*out.columns).alias("_row"))
    P = labels.filter(F.col(k.t).isNotNull()).groupBy(*keys, F.col(k.t).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).cast("double").alias("_k"), F.coalesce(F.sum(F.col(k.y).cast("double")), F.lit(0.0)).alias("_y"))
    P = P.withColumn("_blk", F.explode(F.sequence(block(F.col("_x") - margin), block(F.col("_x") + margin))))

    def means(rows: pa.Table, labels: pa.Table) -> pa.Table:
        get = lambda table, *names: [table[n].to_numpy().astype(float) for n in names]
        x, k, y = get(labels, "_x", "_k", "_y")
        order = np.argsort(x)
        x, k, y = x[order], k[order], y[order]
        place, until, nearest, mine, own = get(rows, "_p", "_cut", "_d0", "_mine", "_own")
        found = {}
        for name, h in widths.items():
            h, out = h * HOUR, np.full(len(place), np.nan)
            found[name] = out
            if not len(x):
                continue
            number = np.floor(x / (h / 2)).astype(np.int64)
            e = (x - (number + 0.5) * (h / 2)) / h
            g = [np.exp(-0.5 * e * e)]
            for j in range(1, size):
                g.append(g[-1] * e / j)
            sums = np.concatenate([np.zeros((1, 2 * size)), np.cumsum(np.stack([w * v for w in (k, y) for v in g], axis=1), axis=0)])
            asked = np.flatnonzero(~np.isnan(nearest))
            for at in range(0, len(asked), 10_000):
                i = asked[at:at + 10_000]
                p, z = place[i], nearest[i] / h
                before, after, end = np.searchsorted(x, p, "left"), np.searchsorted(x, p, "right"), np.searchsorted(x, until[i], "right")
                cell, sw, sy = np.floor(p / (h / 2)).astype(np.int64), np.zeros(len(i)), np.zeros(len(i))
                for off in range(-cells, cells + 1):
                    a, b = np.searchsorted(number, cell + off, "left"), np.minimum(np.searchsorted(number, cell + off, "right"), end)
                    r = (p - (cell + off + 0.5) * (h / 2)) / h
                    power = np.ones((len(i), size))
                    for j in range(1, size):
                        power[:, j] = power[:, j - 1] * r
                    power *= np.exp(0.5 * (z - r) * (z + r))[:, None]
                    for lo, hi in [(a, np.minimum(b, before))] * (off <= 0) + [(np.maximum(a, after), b)] * (off >= 0):
                        m = sums[np.maximum(lo, hi)] - sums[lo]
                        sw += np.einsum("ij,ij->i", power, m[:, :size])
                        sy += np.einsum("ij,ij->i", power, m[:, size:])
                here = np.minimum(before, len(x) - 1)
                others = np.where((after > before) & (end >= after), k[here] - mine[i], 0.0)  # labels at the row's own time but its own
                sw += np.where(others > 0, others, 0.0)
                sy += np.where(others > 0, y[here] - mine[i] * own[i], 0.0)
                out[i] = np.divide(sy, sw, out=np.full(len(i), np.nan), where=sw > 0)
        return pa.table({"_row": rows["_row"], **{n: pa.array(v, from_pandas=True) for n, v in found.items()}})

    n = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = StructType([*Q.select("_row").schema, *StructType.fromDDL(", ".join(f"`{c}` double" for c in names))])
    near = Q.repartition(n, *part).groupBy(*part).cogroup(P.repartition(n, *part).groupBy(*part)).applyInArrow(means, kind).select("_row.*", *names)
    far = out.filter(is_far)
    return near.unionByName(_kernels_of_cells(far, labels, keys, k, widths, rows)) if far.head(1) else near


def _kernels_of_cells(out: DataFrame, labels: DataFrame, keys: list[str], k: Clock, widths: dict[str, float],
             rows: int | None = None) -> DataFrame:
    """Gaussian means of all labels up to the cutoff but the row's own, with weights relative to the nearest one.

    With the nearest label ``z`` widths away, only labels within ``sqrt(z^2 + KERNEL_DROP)`` widths weigh. Their cells hold moments
    about the centre, and exp(r e) is a series in them. Far from all labels r is large, so cells shrink by four a level and the
    series stays short. The cell of the cutoff is read from sums up to it, so no times are joined with each other.
    """
    d0 = F.least(F.abs(F.col(k.t) - F.col("_tp")), F.abs(F.col("_tf") - F.col(k.t)))
    own = F.when(F.col("measured") & (F.col(k.t) <= F.col("_c")), F.col(k.y).cast("double"))
    out = out.withColumns({"_d0": d0, "_own": own})
    farthest = F.lit(out.agg(F.max("_d0")).head()[0] or 0.0)  # one number
    width, each = F.col("_h"), F.explode(F.array(*[F.lit(h * HOUR) for h in widths.values()]))
    level = lambda d: F.greatest(F.ceil(F.log(F.greatest(d / width / GAUSS_REACH, F.lit(1.0))) / F.log(F.lit(4.0))), F.lit(0)).cast("int")
    side = width / 2 / F.pow(F.lit(4.0), F.col("_l"))
    cell = lambda c: F.floor(c / side)
    off = lambda c: (F.col(c) - (F.col("_b") + 0.5) * side) / width
    points = labels.groupBy(*keys, F.col(k.t).alias("_tc")).agg(F.sum(F.col(k.y).cast("double")).alias("_y"), F.count(F.lit(1)).alias("_k"))
    at = points.withColumn("_h", each).withColumn("_l", F.explode(F.sequence(F.lit(0), level(farthest)))).withColumn("_b", cell(F.col("_tc")))
    at = at.withColumn("_e", off("_tc")).withColumn("_g", F.exp(-0.5 * F.col("_e") * F.col("_e")))
    power = [F.lit(1.0)]
    for _ in range(MOMENTS):
        power.append(power[-1] * F.col("_e"))
    parts = {f"{c}{j}": F.col(c) * F.col("_g") * p for c in ("_k", "_y") for j, p in enumerate(power)} | {"_n": F.col("_k")}
    group = [*keys, "_h", "_l", "_b"]
    whole = at.groupBy(*group).agg(*[F.sum(m).alias(n) for n, m in parts.items()])
    upto = Ordered(at, group, "_tc", rows=rows).running({n: ("sum", m) for n, m in parts.items()}).result()
    found = [*keys, k.t, "_d0", "_own"]
    q = out.select(*found, "_c").filter("_d0 is not null").dropDuplicates(found).withColumn("_h", each).withColumn("_l", level(F.col("_d0")))
    z, last = F.col("_d0") / width, cell(F.col("_c"))
    reach = F.sqrt(z * z + KERNEL_DROP) * width
    to = lambda x: cell(F.col(k.t) + x)
    met = F.array_distinct(F.concat(F.sequence(to(-reach), to(-F.col("_d0"))), F.sequence(to(F.col("_d0")), to(reach))))
    q = q.withColumn("_b", F.explode(F.filter(met, lambda b: b <= last)))
    is_cut = F.col("_b") == last
    inner = join_keys(q.filter(~is_cut), whole, group, "inner")
    edge = asof(q.filter(is_cut), upto, group, F.col("_c"), F.col("_tc"), {n: F.col(n) for n in parts}, "_m", "prev", inclusive=True,
                rows=rows)
    both = inner.unionByName(edge.filter("_m is not null").select(*q.columns, "_m.*")).withColumn("_r", off(k.t))
    # The row's own label weighs exp(z^2 / 2) in its cell; alone there, it leaves nothing to round.
    mine = F.col("_own").isNotNull() & (F.col("_b") == to(F.lit(0.0)))
    both = both.filter(~mine | (F.col("_n") > 1))

    def series(c: str, own_value: Column) -> Column:
        total = F.col(f"{c}{MOMENTS}")
        for j in range(MOMENTS - 1, -1, -1):
            total = F.col(f"{c}{j}") + total * F.col("_r") / float(j + 1)
        return F.exp(0.5 * (z - F.col("_r")) * (z + F.col("_r"))) * total - F.when(mine, F.exp(0.5 * z * z) * own_value).otherwise(0.0)

    both = both.select(*found, "_h", series("_k", F.lit(1.0)).alias("_sw"), series("_y", F.col("_own")).alias("_sy"))
    of = lambda c, h: F.sum(F.when(width == h * HOUR, F.col(c)))
    means = both.groupBy(*found).agg(*[(of("_sy", h) / of("_sw", h)).alias(n) for n, h in widths.items()])
    return join_keys(out, means, found).drop("_d0", "_own")


def _kernel_of_times(out: DataFrame, labels: DataFrame, keys: list[str], k: Clock, h: float, name: str) -> DataFrame:
    """Gaussian mean from the distinct times within reach of the nearest labels, matched on time buckets."""
    reach = GAUSS_REACH * h * HOUR
    points = labels.groupBy(*keys, F.col(k.t).alias("_tc")).agg(F.sum(k.y).alias("_y"), F.count(F.lit(1)).alias("_k"))
    b = lambda c: F.floor(F.col(c) / reach)
    places = out.select(*keys, k.t, "_tp", "_tf", "_c").dropDuplicates()
    d0 = F.least(F.abs(F.col(k.t) - F.col("_tp")), F.abs(F.col("_tf") - F.col(k.t)))
    sides = F.array(F.struct(F.col("_tp").alias("a"), F.lit(0).alias("s")), F.struct(F.col("_tf").alias("a"), F.lit(1).alias("s")))
    q = places.withColumn("_d0", d0).withColumn("_s", F.explode(sides)).filter("_s.a is not null")
    start = F.floor(F.col("_s.a") / reach)
    q = q.withColumn("_b", F.explode(F.array(start, F.when(F.col("_s.s") == 0, start - 1).otherwise(start + 1))))
    tc, a = F.col("_tc"), F.col("_s.a")
    inside = F.when(F.col("_s.s") == 0, (tc <= a) & (tc >= a - reach)).otherwise(
        (tc >= a) & (tc <= a + reach) & (tc <= F.col("_c")) & (F.col("_tp").isNull() | (tc > F.col("_tp"))))
    near = q.join(points.withColumn("_b", b("_tc")), [*keys, "_b"]).filter(inside)
    d = (F.col(k.t) - tc) / (h * HOUR)
    z = F.col("_d0") / (h * HOUR)
    w = F.exp(-0.5 * (d * d - z * z))
    s = near.groupBy(*keys, k.t, "_tp", "_tf").agg(F.sum(w * F.col("_k")).alias("_sw"), F.sum(w * F.col("_y")).alias("_sy"))
    x = join_keys(out, s, [*keys, k.t, "_tp", "_tf"])
    # A measured run whose own time is inside a window was counted with weight exp(d0^2/2h^2), which is 1 there.
    own = F.when(F.col("measured") & ((F.col("_tp") == F.col(k.t)) | (F.col("_tf") == F.col(k.t))), 1.0).otherwise(0.0)
    own = F.coalesce(own, F.lit(0.0))
    return x.withColumn(name, (F.col("_sy") - own * F.coalesce(F.col(k.y), F.lit(0.0))) / (F.col("_sw") - own)).drop("_sw", "_sy")


def partner_arrived(df: DataFrame, k: Clock, wafer: str = "wafer", stage: str = "stage") -> DataFrame:
    """Label and lag of the same wafer's other stage, only if it had arrived when this row's prediction was issued."""
    other = df.filter("measured").select(F.col(wafer).alias("_w"), F.col(stage).alias("_s"), F.col(k.y).alias("O_y"), F.col(k.t).alias("_to"))
    flip = F.when(F.col(stage) == "A", "B").otherwise("A")
    out = df.join(other, (F.col(wafer) == F.col("_w")) & (flip == F.col("_s")) & (F.col("_to") <= k.cutoff), "left")
    return out.withColumn("O_lag", (F.col("_to") - F.col(k.t)) / HOUR).drop("_w", "_s", "_to")


def fallback(df: DataFrame, labels: DataFrame, keys: list[str], k: Clock, pred: str, out: str = "final", rows: int | None = None) -> DataFrame:
    """Prediction, else the mean of visible labels of the key, else of all keys, self excluded; ``{out}_fallback`` marks those."""
    x = df
    for name, group in (("_own", keys), ("_any", [])):
        n = range_counts(x, group, k.t, [k.tie], {name: (-1e18, True, k.lag - k.delay, True)}, value=k.y, source=labels, rows=rows if group else None)
        x = join_keys(x, n, [k.tie])
    mine = F.when(F.col("measured") & F.lit(k.looks_ahead), 1).otherwise(0)
    mean = lambda c: F.when(F.col(c) - mine > 0, (F.col(f"{c}_sum") - mine * F.coalesce(F.col(k.y), F.lit(0.0))) / (F.col(c) - mine))
    return x.withColumns({out: F.coalesce(F.col(pred), mean("_own"), mean("_any")), f"{out}_fallback": F.col(pred).isNull()}).drop(
        "_own", "_own_sum", "_any", "_any_sum")
