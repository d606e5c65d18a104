"""Features from neighbouring labelled runs: nearest in time, in sequence, exponentially weighted, and in state space.

Every function takes queries and candidates separately, so which labels a row may see is visible in the plan.
Candidates never include the row itself, and nothing joins all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import cut
from .asof import asof, mean_of, nearest_k, recent_lists
from .ordered import CHUNK, WHOLE, Ordered, join_keys
from .statesearch import StateIndex, state_neighbors

HOUR = 3600.0
#: Order of the series in cell moments: with cells of half a width it is exact to rounding.
MOMENTS = 18
MIN_WEIGHT = 1e-3  # smaller total weights give null
CELL_HALVES = 20  # half-lives per cell of the decayed prefix sums
CELLS_BACK = 3  # earlier cells that still matter: 60 half-lives, below double precision


def _line(lst: Column, n: int, at: Column) -> dict[str, Column]:
    """Sums of an OLS line over the first ``n`` items of structs with ``t`` (seconds) and ``y``, hours from ``at``."""
    part = F.slice(lst, 1, n)
    fold = lambda f: F.aggregate(part, F.lit(0.0), lambda a, x: a + f(x))
    x = lambda s: (s["t"] - at) / HOUR
    return {"n": F.size(part), "sx": fold(x), "sy": fold(lambda s: s["y"]), "sxx": fold(lambda s: x(s) * x(s)),
            "sxy": fold(lambda s: x(s) * s["y"]), "lo": F.array_min(F.transform(part, lambda s: s["y"])),
            "hi": F.array_max(F.transform(part, lambda s: s["y"]))}


def line_estimate(lst: Column, n: int, at: Column, least: int = 1) -> tuple[Column, Column]:
    """(value at ``at`` clipped to the neighbours' range, slope per hour) of a line over the first ``n`` items."""
    return line_of_sums(_line(lst, n, at), F.lit(0.0), least)


def line_sums(lst: Column, n: int, at: Column) -> Column:
    """The sums of ``line_estimate`` as a struct, for rows that carry a line on: as large for 40 items as for one."""
    return F.struct(*[v.alias(c) for c, v in _line(lst, n, at).items()])


def line_of_sums(s: dict[str, Column] | Column, hours: Column, least: int = 1) -> tuple[Column, Column]:
    """``line_estimate`` from sums about a time that is ``hours`` before."""
    mx, my = s["sx"] / s["n"], s["sy"] / s["n"]
    slope = (s["sxy"] - s["sx"] * my) / F.greatest(s["sxx"] - s["sx"] * mx, F.lit(1e-9))
    mx = mx - hours
    ok = s["n"] >= least
    return F.when(ok, F.least(F.greatest(my - slope * mx, s["lo"]), s["hi"])), F.when(ok, slope)


def time_neighbors(queries: DataFrame, cands: DataFrame, keys: list[str], t: str, tie: str, y: str,
                   ks: tuple[int, ...] = (1, 3, 10), trends: tuple[int, ...] = (15, 40), prefix: str = "NB_",
                   rows: int | None = None) -> DataFrame:
    """Mean label of the k nearest in time, nearest distance in hours, and local linear trends.

    In one dimension the k nearest are among the k before and the k after, so lists of that length are exact.
    """
    k = max([*ks, *trends])
    out = nearest_k(queries, cands, keys, t, tie, {"t": F.col(t), "y": F.col(y)}, k, rows)
    mark = lambda lst, side: F.transform(lst, lambda s, i: F.struct(
        F.abs(s["t"] - F.col(t)).alias("d"), F.lit(side).alias("s"), i.alias("i"), s["t"].alias("t"), s["y"].alias("y")))
    out = out.withColumn("_near", F.slice(F.sort_array(F.concat(mark(F.col("_before"), 0), mark(F.col("_after"), 1))), 1, k))
    cols = {f"{prefix}time_{n}": mean_of(F.col("_near"), "y", n) for n in ks}
    cols[f"{prefix}time_dist1"] = F.get(F.col("_near"), 0)["d"] / HOUR
    for n in trends:
        cols[f"{prefix}trend_{n}"], cols[f"{prefix}slope_{n}"] = line_estimate(F.col("_near"), n, F.col(t))
    return out.withColumns(cols).drop("_before", "_after", "_near")


def deviations(df: DataFrame, ref: Column, keys: list[str], y: str, out: str = "dev") -> DataFrame:
    """``mu``: mean label of the key's reference rows; ``dev``: label minus ``mu``."""
    mu = df.groupBy(*keys).agg(F.avg(F.when(ref, F.col(y))).alias("mu"))
    return join_keys(df, mu, keys).withColumn(out, F.col(y) - F.col("mu"))


def sequence_neighbors(queries: DataFrame, cands: DataFrame, keys: list[str], t: str, tie: str, dev: str, name: str,
                       n: int = 3, rows: int | None = None) -> DataFrame:
    """Deviation and gap of the previous (strictly earlier) and next (same time or later, not itself) candidates."""
    item = {"t": F.col(t), "y": F.col(dev), "id": F.col(tie)}
    R = recent_lists(cands, keys, t, [tie], item, n, n + 1, rows)
    at = dict(lt=F.col(t), rt=F.col(t), rtie=F.col(tie), rows=rows)
    out = asof(queries, R, keys, payload={"l": F.reverse("_back")}, out="_p", side="prev", **at)
    out = asof(out, R, keys, payload={"l": F.col("_ahead")}, out="_n", side="next", inclusive=True, **at)
    nxt = F.filter("_n.l", lambda s: s["id"] != F.col(tie))
    cols = {}
    for side, lst, sign in (("prev", F.col("_p.l"), 1.0), ("next", nxt, -1.0)):
        first = F.get(lst, 0)
        cols[f"{name}_{side}1"] = first["y"]
        cols[f"{name}_{side}{n}"] = mean_of(lst, "y", n)
        cols[f"{name}_{side}_gap"] = sign * (F.col(t) - first["t"]) / HOUR
    return out.withColumns(cols).drop("_p", "_n")


# -- exponentially weighted means ----------------------------------------------------------------
def ewm_states(df: DataFrame, keys: list[str], t: str, tie: list[str], y: str, halves: dict[str, float], counts: dict[str, float],
               rows: int | None = None) -> DataFrame:
    """``s_{name}``, ``w_{name}``: decayed label and weight sums of all rows up to this one, at this row's position.

    ``halves`` are half-lives in the unit of ``t``, ``counts`` in rows.
    """
    o = Ordered(df, keys, t, tie, rows)
    if o.split:
        return _ewm_slices(o, y, halves, counts)
    return _ewm_cells(numbered(_ewm_cells(df, keys, t, tie, y, halves), keys, t, tie, WHOLE), keys, "_pos", tie, y, counts)


def _ewm_cells(df: DataFrame, keys: list[str], pos: str, tie: list[str], y: str, halves: dict[str, float]) -> DataFrame:
    """Decayed sums of keys that fit in one slice, by windows.

    Positions are cut into cells of 20 half-lives. Inside a cell a plain running sum of rescaled labels is exact;
    the few earlier cells that still carry weight come from a per-cell total. Neither overflows on long spans.
    """
    out = df
    for name, h in halves.items():
        width = CELL_HALVES * h
        scale = F.pow(F.lit(2.0), (F.col(pos) - F.col("_cell") * width) / h)
        x = out.withColumn("_cell", F.floor(F.col(pos) / width))
        back = lambda c, w: sum((F.coalesce(F.sum(c).over(w.rangeBetween(-i, -i)), F.lit(0.0)) * 2.0 ** (-CELL_HALVES * i)
                                 for i in range(1, CELLS_BACK + 1)), F.lit(0.0))
        # every key fits in one task: the earlier cells are a range frame of the same partition
        run = Window.partitionBy(*keys, "_cell").orderBy(pos, *tie).rowsBetween(Window.unboundedPreceding, 0)
        w = Window.partitionBy(*keys).orderBy("_cell")
        x = x.withColumns({"_vs": F.col(y) * scale, "_vw": scale})
        x = x.withColumns({"_ps": F.sum("_vs").over(run), "_pw": F.sum("_vw").over(run)})
        x = x.withColumns({"_cs": back("_vs", w), "_cw": back("_vw", w)}).drop("_vs", "_vw")
        out = x.withColumns({f"s_{name}": (F.col("_ps") + F.col("_cs")) / scale,
                             f"w_{name}": (F.col("_pw") + F.col("_cw")) / scale}).drop("_ps", "_pw", "_cs", "_cw", "_cell")
    return out


def _ewm_slices(o: Ordered, y: str, halves: dict[str, float], counts: dict[str, float]) -> DataFrame:
    """Decayed sums of all half-lives in one scan of each slice; what enters a slice decays on from the slices before it."""
    names, t, part = [*halves, *counts], o.t, o.part
    half = np.array([*halves.values(), *counts.values()], float)[:, None]
    timed = np.arange(len(names))[:, None] < len(halves)
    cols = [f"{c}_{n}" for c in ("s", "w") for n in names]
    # rows without a time come first: they weigh by count only
    x = o.df.withColumns({"_v": F.coalesce(F.col(y).cast("double"), F.lit(0.0)), "_x": F.col(t).cast("double")})
    x = x.repartition(*part).sortWithinPartitions(*part, *o.order()).withColumn("_group", F.to_json(F.struct(*part)))
    kept = [f for f in o.df.schema if f.name not in cols]
    schema = StructType([*kept, *StructType.fromDDL(", ".join(f"`{c}` double" for c in [*cols, "_seen"]))])

    def inside(batches):
        last, carry, at = None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group, pos, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_group", "_x", "_v"))
            known = ~np.isnan(pos)
            row = np.arange(n)
            start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], row, 0))
            goes_on = group[0] == last
            before = np.r_[at[0] if goes_on else np.nan, pos[:-1]]
            before[(start == row) & ~((row == 0) & goes_on)] = np.nan
            dx = np.nan_to_num(pos - before)
            a = np.exp2(-np.where(timed, dx, 1.0) / half)
            here = np.where(timed, known, True)
            s, w = np.where(here, v, 0.0), here.astype(float)
            step = 1
            while len(i := np.flatnonzero(row - step >= start)):
                j = i - step
                s[:, i], w[:, i], a[:, i] = s[:, j] * a[:, i] + s[:, i], w[:, j] * a[:, i] + w[:, i], a[:, j] * a[:, i]
                step *= 2
            seen = (row - start + 1).astype(float)
            if goes_on:
                i = np.flatnonzero(start == 0)
                s[:, i], w[:, i] = s[:, i] + carry[0][:, None] * a[:, i], w[:, i] + carry[1][:, None] * a[:, i]
                seen[i] += at[1]
            last, carry, at = group[-1], (s[:, -1].copy(), w[:, -1].copy()), (pos[-1], seen[-1])
            hidden = timed & ~known
            s[hidden], w[hidden] = np.nan, np.nan
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *[pa.array(c, from_pandas=True) for c in (*s, *w, seen)]], names=schema.names)

    done = cut(x.mapInArrow(inside, schema))  # read for its rows and for the last row of each slice
    ends = done.groupBy(*part).agg(F.max_by(F.struct(F.col(t).cast("double").alias("_end"), "_seen", *cols), "_seen").alias("_e")).select(*part, "_e.*")
    entering = [f"_in_{c}" for c in cols]
    state = StructType([*done.select(*part).schema, *StructType.fromDDL(", ".join(f"`{c}` double" for c in ["_from", *entering]))])

    def across(pdf):
        pdf = pdf.assign(_o=[tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in pdf[CHUNK]]).sort_values("_o")
        m, acc, at, out = len(names), None, np.nan, []
        for end, seen, own in zip(pdf["_end"], pdf["_seen"], np.nan_to_num(pdf[cols].to_numpy(float))):
            out.append(np.r_[at, np.full(2 * m, np.nan) if acc is None else acc])
            a = np.exp2(-np.where(timed, np.nan_to_num(end - at), seen) / half)[:, 0]
            acc = own if acc is None else np.tile(a, 2) * acc + own
            at = at if np.isnan(end) else end
        return pdf[part].assign(**dict(zip(["_from", *entering], np.array(out).T)))

    # Only slices of a key that was cut have one before them, so the states that enter are as few as the hot groups.
    carry = ends.groupBy(*o.keys).applyInPandas(across, state).filter(F.col(entering[-1]).isNotNull())
    x = join_keys(done, F.broadcast(carry), part)
    way = [F.coalesce((F.col(t) - F.col("_from")) / h, F.lit(0.0)) for h in halves.values()] + [F.col("_seen") / h for h in counts.values()]
    both = {f"{c}_{n}": F.col(f"{c}_{n}") + F.coalesce(F.col(f"_in_{c}_{n}") * F.pow(F.lit(2.0), -d), F.lit(0.0)) for c in ("s", "w") for n, d in zip(names, way)}
    return x.withColumns(both).drop(*entering, "_from", "_seen", CHUNK)


def numbered(df: DataFrame, keys: list[str], t: str, tie: list[str], rows: int | None = None) -> DataFrame:
    """``_pos``: position of each candidate in its key, as a double."""
    o = Ordered(df, keys, t, tie, rows).running({"_pos": ("count", F.lit(1))})
    return o.result().withColumn("_pos", F.col("_pos").cast("double"))


def ewm_features(queries: DataFrame, cands: DataFrame, keys: list[str], t: str, tie: str, y: str,
                 hours: dict[str, float], counts: dict[str, float], prefix: str, side: str = "prev",
                 by_position: bool = False, rows: int | None = None) -> DataFrame:
    """``{prefix}{name}``: weighted mean over strictly earlier (or later) candidates, by time and by count half-life."""
    sign = 1.0 if side == "prev" else -1.0
    R = cands.withColumns({"_x": sign * F.col(t), "_xt": (sign * F.col(tie)).cast("bigint")})
    R = ewm_states(R, keys, "_x", ["_xt"], y, {n: h * HOUR for n, h in hours.items()}, counts, rows)
    names = [*hours, *counts]
    pay = {"t": F.col(t), **{f"{k}_{n}": F.col(f"{k}_{n}") for n in names for k in ("s", "w")}}
    out = asof(queries, R, keys, F.col(t), F.col(t), pay, "_e", side, ltie=F.col(tie), rtie=F.col(tie),
               by_position=by_position, rows=rows)
    age = F.abs(F.col(t) - F.col("_e.t")) / HOUR
    cols = {}
    for n in names:
        s, w = F.col(f"_e.s_{n}"), F.col(f"_e.w_{n}")
        decay = F.pow(F.lit(0.5), age / hours[n]) if n in hours else F.lit(1.0)
        cols[f"{prefix}{n}"] = F.when(w * decay >= MIN_WEIGHT, s / w)
    return out.withColumns(cols).drop("_e")


def neighbor_deltas(queries: DataFrame, cands: DataFrame, keys: list[str], t: str, tie: str, state: list[str],
                    prefix: str, rows: int | None = None) -> DataFrame:
    """State minus that of the closest strictly earlier / later candidate."""
    pay = {c: F.col(c) for c in state}
    at = dict(lt=F.col(t), rt=F.col(t), rtie=F.col(tie), rows=rows)
    out = asof(queries, cands, keys, payload=pay, out="_p", side="prev", **at)
    out = asof(out, cands, keys, payload=pay, out="_n", side="next", **at)
    cols = {f"{prefix}{side}_{c}": F.col(c) - F.col(f"{h}.{c}") for side, h in (("prev", "_p"), ("next", "_n")) for c in state}
    return out.withColumns(cols).drop("_p", "_n")


# -- kernels over a bounded horizon ---------------------------------------------------------------
GAUSS_REACH = 9.0  # a Gaussian weight this many widths away is below 1e-17
CELLS_A_BLOCK = 64  # cells of half a width that a task holds at once, besides a reach on both sides


def kernel_sums(queries: DataFrame, cands: DataFrame, keys: list[str], t: str, y: str, kernels: dict[str, tuple[str, float]],
                own: Column | None = None) -> DataFrame:
    """``k_{name}`` and ``n_{name}``: kernel mean and total weight of candidates around each query, self removed.

    Candidates are first summed per distinct time and queries reduced to distinct times. For the Gaussian kernel the candidates of a
    cell of half a width become moments about its centre; a query then meets some 36 cells, however many candidates they
    hold, and the series of exp(r e) in the moments is exact to rounding. The tricube kernel is matched on time buckets.
    kernels: name -> ("gauss", width in hours) or ("tricube", half-width in hours). ``own`` marks queries that are candidates.
    """
    points = cands.groupBy(*keys, t).agg(F.sum(y).alias("_y"), F.count(F.lit(1)).alias("_k"))
    places = queries.select(*keys, t).dropDuplicates()
    at_own = points.select(*keys, t, F.col("_k").alias("_hk"), F.col("_y").alias("_hy"))
    # file sizes say little about rows, so these joins are merges: an estimate must not send a side through the driver
    out = join_keys(queries, at_own.hint("merge"), [*keys, t])
    mine = F.lit(0) if own is None else F.when(own, 1).otherwise(0)
    rest = F.coalesce("_hk", F.lit(0)) - mine
    own_y = F.when(rest > 0, F.coalesce("_hy", F.lit(0.0)) - mine * F.coalesce(F.col(y), F.lit(0.0))).otherwise(0.0)
    out = out.withColumns({"_rest": rest, "_own_y": own_y}).drop("_hk", "_hy")
    for name, (kind, h) in kernels.items():
        s = (_gauss_sums if kind == "gauss" else _tricube_sums)(places, points, keys, t, h * HOUR)
        out = join_keys(out, s.hint("merge"), [*keys, t])
        # Candidates at the query's own time weigh 1 each: the sums leave them out, all but its own label come back.
        sw = F.coalesce("_sw", F.lit(0.0)) + F.col("_rest")
        sy = F.coalesce("_sy", F.lit(0.0)) + F.col("_own_y")
        out = out.withColumns({f"n_{name}": sw, f"k_{name}": F.when(sw >= MIN_WEIGHT, sy / sw)}).drop("_sw", "_sy")
    return out.drop("_rest", "_own_y")


def _tricube_sums(places: DataFrame, points: DataFrame, keys: list[str], t: str, half: float) -> DataFrame:
    """Weights and weighted labels of the candidates around each place, those at its own time left out."""
    b = lambda c: F.floor(F.col(c) / half)
    P = points.select(*keys, F.col(t).alias("_tc"), "_y", "_k", b(t).alias("_b"))
    Q = places.withColumn("_b", F.explode(F.array(b(t) - 1, b(t), b(t) + 1)))
    near = Q.join(P, [*keys, "_b"]).filter((F.abs(F.col(t) - F.col("_tc")) <= half) & (F.col("_tc") != F.col(t)))
    u = F.abs(F.col(t) - F.col("_tc")) / half
    w = F.pow(1 - u * u * u, F.lit(3.0))
    return near.groupBy(*keys, t).agg(F.sum(w * F.col("_k")).alias("_sw"), F.sum(w * F.col("_y")).alias("_sy"))


def _gauss_sums(places: DataFrame, points: DataFrame, keys: list[str], t: str, width: float) -> DataFrame:
    """The same for exp(-d^2 / 2), d in widths, from moments of cells of half a width.

    Places and cells meet in blocks of cells, each with a margin of one reach: a place crosses the network once, not once for each
    cell that it meets, and nothing is broadcast. A task holds the cells of a block and goes through its places batch by batch.
    """
    cell = width / 2
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, t)])
    e = (F.col(t) - (F.col("_b") + 0.5) * cell) / width
    near = points.filter(known).withColumn("_b", F.floor(F.col(t) / cell)).withColumns({"_e": e, "_g": F.exp(-0.5 * e * e)})
    power = [F.lit(1.0)]
    for _ in range(MOMENTS):
        power.append(power[-1] * F.col("_e"))
    # one array of products a row would be interpreted; sums of expressions stay compiled
    sums = {f"_{c}{j}": F.sum(F.col(c) * F.col("_g") * p) for c in ("_k", "_y") for j, p in enumerate(power)}
    cells = near.groupBy(*keys, "_b").agg(*[s.alias(n) for n, s in sums.items()])
    far = round(2 * GAUSS_REACH)  # cells in a reach
    block = lambda b: F.floor(b / CELLS_A_BLOCK)
    b = F.col("_b")
    moments = F.array(*[F.coalesce(n, F.lit(0.0)) for n in sums])
    C = cells.select(*keys, F.lit(None).cast("double").alias(t), "_b", F.explode(F.sequence(block(b - far), block(b + far))).alias("_blk"), moments.alias("_m"))
    Q = places.filter(known).select(*keys, F.col(t).cast("double").alias(t), F.floor(F.col(t) / cell).alias("_b"))
    Q = Q.select(*keys, t, "_b", block(b).alias("_blk"), F.lit(None).cast("array<double>").alias("_m"))
    part = [*keys, "_blk"]
    both = Q.unionByName(C).repartition(*part).sortWithinPartitions(*part, F.col("_m").isNull())  # a block's cells come first
    both = both.withColumn("_group", F.to_json(F.struct(*part)))
    size = CELLS_A_BLOCK + 2 * far

    def inside(batches):
        last, kept = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            group, is_place = pdf["_group"].to_numpy(), pdf["_m"].isna().to_numpy()
            number = np.cumsum(np.r_[False, group[1:] != group[:-1]])
            slot = number * size + pdf["_b"].to_numpy(np.int64) - pdf["_blk"].to_numpy(np.int64) * CELLS_A_BLOCK + far
            table = np.zeros((2 * (MOMENTS + 1), (number[-1] + 1) * size))
            if group[0] == last:  # the block goes on from the batch before
                table[:, :size] = kept
            if not is_place.all():
                table[:, slot[~is_place]] = np.stack(pdf["_m"][~is_place].to_list()).T
            last, kept = group[-1], table[:, -size:].copy()
            out, slot = pdf[is_place], slot[is_place]
            mid = (out[t].to_numpy(float) - (out["_b"].to_numpy(float) + 0.5) * cell) / width
            total = np.zeros((2, len(out)))
            for off in range(-far, far + 1):
                at, r = slot + off, mid - off * 0.5
                for c in range(2):
                    series = table[c * (MOMENTS + 1) + MOMENTS][at]
                    for j in range(MOMENTS - 1, -1, -1):
                        series = table[c * (MOMENTS + 1) + j][at] + series * r / (j + 1)
                    total[c] += np.exp(-0.5 * r * r) * series
            yield out[[*keys, t]].assign(_sw=total[0], _sy=total[1])

    found = both.mapInPandas(inside, StructType([*both.select(*keys, t).schema, *StructType.fromDDL("_sw double, _sy double")]))
    here = points.select(*keys, F.col(t).cast("double").alias(t), F.col("_k").alias("_hk"), F.col("_y").alias("_hy"))
    s = join_keys(found, here.hint("merge"), [*keys, t])
    return s.select(*keys, t, (F.col("_sw") - F.coalesce("_hk", F.lit(0))).alias("_sw"), (F.col("_sy") - F.coalesce("_hy", F.lit(0.0))).alias("_sy"))


LINE_TIMES = 400.0  # distinct times in a reach beyond which moments of cells are cheaper than pairs of times
LINE_CELLS, LINE_BLOCK = 8, 4  # cells in a reach; reaches of places that a task holds at once, besides one on both sides


def local_line(queries: DataFrame, cands: DataFrame, keys: list[str], t: str, tie: str, y: str, half: float, own: Column,
               prefix: str, dense_times: float = LINE_TIMES) -> DataFrame:
    """Tricube-weighted local line: value at the query clipped to its neighbours' range, and slope per hour.

    A time meets the distinct label times in its reach where they are at most ``dense_times`` on average, else moments of cells.
    """
    reach = half * HOUR
    # The two smallest and two largest labels per time keep the range exact once the query's own label is taken out.
    per_label = cands.groupBy(*keys, t, F.col(y).alias("_ly")).agg(F.count(F.lit(1)).alias("_k"))
    o = Ordered(per_label, [*keys, t], "_ly").running({"_c": ("sum", F.col("_k"))})
    o = o.running({"_cr": ("sum", F.col("_k"))}, reverse=True)
    edge = F.col("_c") - F.col("_k") < 2
    top = F.col("_cr") - F.col("_k") < 2
    rep = lambda c: F.array_repeat(F.col("_ly"), F.least(F.col("_k"), F.lit(2)).cast("int"))
    points = cut(o.result().groupBy(*keys, t).agg(  # read for the pairs and for the query's own time
        F.sum(F.col("_ly") * F.col("_k")).alias("_y"), F.sum("_k").alias("_k"),
        F.slice(F.sort_array(F.flatten(F.collect_list(F.when(edge, rep("x"))))), 1, 2).alias("_lo"),
        F.slice(F.sort_array(F.flatten(F.collect_list(F.when(top, rep("x")))), False), 1, 2).alias("_hi")))
    spans = points.groupBy(*keys, F.floor(F.col(t) / reach)).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    each = spans.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).head()[0] or 0.0  # one number
    s = (_line_of_cells if each > dense_times else _line_of_pairs)(queries.select(*keys, t).dropDuplicates(), points, keys, t, half)
    # The point at the query's own time comes by a join: an array in the sums above would sort all pairs instead of adding them up.
    here = points.select(*keys, t, F.struct("_lo", "_hi", "_k", "_y").alias("_here"))
    x = join_keys(join_keys(queries, s, [*keys, t]), here, [*keys, t])
    mine = F.when(own, 1).otherwise(0)
    same = F.coalesce(F.col("_here._k"), F.lit(0)) - mine
    s0 = F.col("_s0") + same
    t0 = F.col("_t0") + F.when(same > 0, F.col("_here._y") - mine * F.coalesce(F.col(y), F.lit(0.0))).otherwise(0.0)
    s1, s2, t1 = F.col("_s1"), F.col("_s2"), F.col("_t1")
    # At the query's own time drop one copy of its label from the two extremes kept there.
    rest = lambda f: F.get(F.when(own & (F.get(f"_here.{f}", F.lit(0)) == F.col(y)), F.slice(f"_here.{f}", 2, 2)).otherwise(F.col(f"_here.{f}")), F.lit(0))
    lo, hi = F.least(F.col("_mn"), rest("_lo")), F.greatest(F.col("_mx"), rest("_hi"))
    det = s0 * s2 - s1 * s1
    ok = (s0 >= 3 * MIN_WEIGHT) & (det > 1e-9)
    est = F.least(F.greatest((s2 * t0 - s1 * t1) / det, lo), hi)
    return x.withColumns({f"{prefix}est": F.when(ok, est), f"{prefix}slope": F.when(ok, (s0 * t1 - s1 * t0) / det)}).drop(
        "_s0", "_s1", "_s2", "_t0", "_t1", "_mn", "_mx", "_here")


def _line_of_pairs(places: DataFrame, points: DataFrame, keys: list[str], t: str, half: float) -> DataFrame:
    """Weighted sums for the line at each place and the range of its labels, those at its own time left out."""
    reach = half * HOUR
    b = lambda c: F.floor(F.col(c) / reach)
    P = points.select(*keys, F.col(t).alias("_tc"), "_y", "_k", "_lo", "_hi", b(t).alias("_b"))
    Q = places.withColumn("_b", F.explode(F.array(b(t) - 1, b(t), b(t) + 1)))
    d = (F.col(t) - F.col("_tc")) / HOUR
    u = F.abs(d) / half
    w = F.pow(1 - u * u * u, F.lit(3.0))
    near = Q.join(P, [*keys, "_b"]).filter(u < 1)
    at_self = F.col("_tc") == F.col(t)
    return near.groupBy(*keys, t).agg(
        F.sum(F.when(at_self, 0.0).otherwise(w * F.col("_k"))).alias("_s0"), F.sum(w * d * F.col("_k")).alias("_s1"), F.sum(w * d * d * F.col("_k")).alias("_s2"),
        F.sum(F.when(at_self, 0.0).otherwise(w * F.col("_y"))).alias("_t0"), F.sum(w * d * F.col("_y")).alias("_t1"),
        F.min(F.when(~at_self, F.get("_lo", F.lit(0)))).alias("_mn"), F.max(F.when(~at_self, F.get("_hi", F.lit(0)))).alias("_mx"))


def _line_of_cells(places: DataFrame, points: DataFrame, keys: list[str], t: str, half: float) -> DataFrame:
    """The same without pairs: the weights are polynomials on either side of a place, so their sums follow from moments of cells.

    Labels of a block of time lie sorted in one task, with a reach on both sides. Running sums of their moments about the centre of
    their cell give any part of a cell; ranges of labels come from minima and maxima over powers of two.
    """
    reach, known = half * HOUR, reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, t)])
    block, part = lambda c: F.floor(c / (LINE_BLOCK * reach)), [*keys, "_blk"]
    P = points.filter(known).select(*keys, F.explode(F.sequence(block(F.col(t) - reach), block(F.col(t) + reach))).alias("_blk"), F.col(t).cast("double").alias("_x"), F.col("_k").cast("double").alias("_k"),
                                    F.col("_y").cast("double").alias("_y"), F.get("_lo", F.lit(0)).cast("double").alias("_lo"), F.get("_hi", F.lit(0)).cast("double").alias("_hi"))
    Q = places.filter(known).select(*keys, t, block(F.col(t)).alias("_blk"))
    powers, side, cell = 12, LINE_CELLS + 1, reach / LINE_CELLS
    # v^q (1 - v^3)^3 about r = v + e as a polynomial in r for each power of e; on the right of a place v runs the other way
    tricube = {0: 1.0, 3: -3.0, 6: 3.0, 9: -1.0}
    about = {}
    for q in range(3):
        for sign in (1, -1):
            m = about[q, sign] = np.zeros((powers, powers))
            for j, c in ((n + q, c) for n, c in tricube.items()):
                for i in range(j + 1):
                    m[j - i, i] += c * sign**j * comb(j, i) * (-1) ** i

    def tables(v: np.ndarray, least: Callable) -> list[np.ndarray]:
        out = [v]
        while 2 << len(out) - 1 <= len(v):
            step = 1 << len(out) - 1
            out.append(least(out[-1][:-step], out[-1][step:]))
        return out

    def extreme(table: list[np.ndarray], a: np.ndarray, b: np.ndarray, least: Callable) -> np.ndarray:
        """Over [a, b) of each row, not a number where that is empty."""
        out, level = np.full(len(a), np.nan), np.frexp(np.maximum(b - a, 1))[1] - 1
        for k, values in enumerate(table):
            i = np.flatnonzero((level == k) & (b > a))
            out[i] = least(values[a[i]], values[b[i] - (1 << k)])
        return out

    def sums(places: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        labels = labels.sort_values("_x")
        x, k, y = (labels[c].to_numpy(float) for c in ("_x", "_k", "_y"))
        number = np.floor(x / cell).astype(np.int64)
        e = (x - (number + 0.5) * cell) / reach
        moments = np.cumsum(np.stack([w * e**j for w in (k, np.nan_to_num(y)) for j in range(powers)], axis=1), axis=0)
        moments = np.concatenate([np.zeros((1, 2 * powers)), moments])
        low, high = tables(labels["_lo"].to_numpy(float), np.fmin), tables(labels["_hi"].to_numpy(float), np.fmax)
        found = []
        for at in range(0, len(places), 20_000):
            some = places.iloc[at:at + 20_000]
            p = some[t].to_numpy(float)
            first, before, after, end = (np.searchsorted(x, v, s) for v, s in ((p - reach, "right"), (p, "left"), (p, "right"), (p + reach, "left")))
            own, total = np.floor(p / cell).astype(np.int64), np.zeros((5, len(p)))
            for off in range(-side, side + 1):
                c = own + off
                a, b = np.searchsorted(number, c, "left"), np.searchsorted(number, c, "right")
                r = ((p - (c + 0.5) * cell) / reach)[:, None] ** np.arange(powers)
                for sign, lo, hi in ((1, first, before), (-1, after, end)):
                    lo, hi = np.maximum(a, lo), np.minimum(b, hi)
                    if sign * off <= 0 and (hi > lo).any():
                        m = moments[np.maximum(hi, lo)] - moments[lo]
                        for q in range(3):
                            way = (sign * half) ** q * (r @ about[q, sign])
                            total[q] += (way * m[:, :powers]).sum(1)
                            if q < 2:
                                total[3 + q] += (way * m[:, powers:]).sum(1)
            mn = np.fmin(extreme(low, first, before, np.fmin), extreme(low, after, end, np.fmin))
            mx = np.fmax(extreme(high, first, before, np.fmax), extreme(high, after, end, np.fmax))
            found.append(some[[*keys, t]].assign(**dict(zip(("_s0", "_s1", "_s2", "_t0", "_t1"), total)), _mn=mn, _mx=mx)[end > first])
        return pd.concat(found) if found else places[[*keys, t]].iloc[:0].assign(**dict.fromkeys(("_s0", "_s1", "_s2", "_t0", "_t1", "_mn", "_mx"), 0.0))

    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = StructType([*Q.select(*keys, t).schema, *StructType.fromDDL(", ".join(f"{c} double" for c in ("_s0", "_s1", "_s2", "_t0", "_t1", "_mn", "_mx")))])
    return Q.repartition(n, *part).groupBy(*part).cogroup(P.repartition(n, *part).groupBy(*part)).applyInPandas(sums, out)


# -- nearest in state space ------------------------------------------------------------------------
def nearest_weighted(k: int, y: str = "y") -> Column:
    """Mean of the ``k`` nearest of ``_state``, weighted by the inverse of their distance."""
    near = F.slice("_state", 1, k)
    w = lambda s: 1.0 / (s["d"] + 1e-3)
    num = F.aggregate(near, F.lit(0.0), lambda a, s: a + w(s) * s[y])
    den = F.aggregate(near, F.lit(0.0), lambda a, s: a + w(s))
    return F.when(F.size(near) > 0, num / den)


def weighted_state_regressor(queries: DataFrame, cands: DataFrame, keys: list[str], state: list[str], tie: str, y: str, scales: list[float],
                             ks: list[int], rows: int | None = None, passes: int = 2) -> DataFrame:
    """Distance-weighted nearest-state prediction with column scales and k chosen greedily by leave-one-out error over all keys.

    Columns start at one deviation and the second of ``ks``. In each pass every column in turn takes the scale with the least
    leave-one-out error of the candidates, then k does; a change must lower the error. The candidates are blocked once; all scales of a
    column and all k are scored in one search, which weights the same squared differences.
    """
    std = cands.agg(*[F.greatest(F.stddev_samp(c), F.lit(1e-9)).alias(c) for c in state]).head()  # one row of scales
    index = StateIndex(cands, keys, state, tie, y, rows)
    own = index.asking(cands)
    factors = lambda trials: [[f[c] / float(std[c]) for c in state] for f in trials]
    labels = cands.select(*keys, tie, y)

    def losses(trials: list[dict[str, float]]) -> list[dict[int, float]]:
        near = join_keys(labels, index.search(own, max(ks), factors(trials)), [*keys, tie], "inner")
        e = {k: nearest_weighted(k) - F.col(y) for k in ks}
        per = near.groupBy("_trial").agg(*[F.avg(e[k] * e[k]).alias(f"k{k}") for k in ks]).collect()  # one row a trial
        found = {r["_trial"]: {k: r[f"k{k}"] if r[f"k{k}"] is not None else float("inf") for k in ks} for r in per}
        return [found.get(i, dict.fromkeys(ks, float("inf"))) for i in range(len(trials))]

    best, k, now = dict.fromkeys(state, 1.0), ks[min(1, len(ks) - 1)], None
    for _ in range(passes):
        for c in state:
            trials = [best] * (now is None) + [{**best, c: float(s)} for s in scales if s != best[c]]
            for trial, score in zip(trials, losses(trials) if trials else []):
                if now is None or score[k] < now[k] - 1e-9:
                    best, now = trial, score
        for other in ks:
            k = other if now[other] < now[k] - 1e-9 else k
    found = index.search(index.asking(queries), k, factors([best])).drop("_trial")
    return join_keys(queries, found, [*keys, tie]).select(*keys, tie, y, nearest_weighted(k).alias("pred"))
