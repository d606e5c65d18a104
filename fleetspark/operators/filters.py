"""Order-dependent linear filters per key: EWMA levels and local-level smoothing.

They are associative: the effect of a row is a small element (A, b, C, eta, J) and elements compose, as in
parallel Kalman smoothing (Sarkka and Garcia-Fernandez, 2021). A hot key is therefore scanned slice by slice in
parallel and the slices are joined by composing one element per slice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import cut
from .asof import asof
from .ordered import CHUNK, WHOLE, Ordered, join_keys, key_rows

ELEMENT = ("A", "b", "C", "eta", "J")
GAP_HOURS = 0.25  # a pause longer than this adds jump noise


def compose(e, f):
    """Element of ``e`` followed by ``f``."""
    d = 1.0 / (1.0 + e[2] * f[4])
    return (f[0] * d * e[0], f[0] * d * (e[1] + e[2] * f[3]) + f[1], f[0] * d * e[2] * f[0] + f[2],
            e[0] * d * (f[3] - f[4] * e[1]) + e[3], e[0] * d * f[4] * e[0] + e[4])


def apply_element(m: Column, p: Column, e: Callable[[str], Column]) -> tuple[Column, Column]:
    """State ``(m, p)`` pushed through an element."""
    d = 1.0 / (1.0 + p * e("J"))
    return e("A") * d * (m + p * e("eta")) + e("b"), e("A") * e("A") * d * p + e("C")


def _compose_columns(e: Callable[[str], Column], f: Callable[[str], Column]) -> dict[str, Column]:
    d = 1.0 / (1.0 + e("C") * f("J"))
    return {"A": f("A") * d * e("A"), "b": f("A") * d * (e("b") + e("C") * f("eta")) + f("b"),
            "C": f("A") * d * e("C") * f("A") + f("C"), "eta": e("A") * d * (f("eta") - f("J") * e("b")) + e("eta"),
            "J": e("A") * d * f("J") * e("A") + e("J")}


def scan(df: DataFrame, keys: list[str], t: str, tie: list[str], prefix: str, reverse: bool = False, inner_first: bool = False,
         rows: int | None = None) -> DataFrame:
    """Replace the element columns ``{prefix}A..J`` of each row by the composition of all rows up to it.

    ``reverse`` scans from the last row. ``inner_first`` lets each new row act before the rows scanned so far.
    """
    o = Ordered(df, keys, t, tie, rows)
    cols = [f"{prefix}{c}" for c in ELEMENT]
    order, part = [t, *tie], o.part
    schema = o.df.schema

    def inside(batches):
        # Rows arrive sorted by group and order. Within a batch the groups are scanned together by doubling; the first group
        # goes on from the last row of the batch before.
        join = (lambda early, late: compose(late, early)) if inner_first else compose
        last, carry = None, None
        for pdf in batches:
            n, group = len(pdf), pdf["_group"].to_numpy()
            acc = [pdf[c].to_numpy(float).copy() for c in cols]
            if n:
                row = np.arange(n)
                start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], row, 0))
                step = 1
                while len(at := np.flatnonzero(row - step >= start)):
                    for x, v in zip(acc, join([x[at - step] for x in acc], [x[at] for x in acc])):
                        x[at] = v
                    step *= 2
                if last is not None and group[0] == last:
                    at = np.flatnonzero(start == 0)
                    for x, v in zip(acc, join(carry, [x[at] for x in acc])):
                        x[at] = v
                last, carry = group[-1], [x[-1] for x in acc]
            pdf[cols] = np.column_stack(acc)
            yield pdf.drop(columns="_group")

    x = o.df.repartition(*part) if part else o.df.coalesce(1)  # without keys the input is one checked slice
    seq = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    x = x.sortWithinPartitions(*part, *seq).withColumn("_group", F.to_json(F.struct(*part)) if part else F.lit(""))
    done = x.mapInPandas(inside, schema)
    if not o.split:
        return done
    done = cut(done)  # three consumers
    at = F.struct(*[F.col(c) for c in order])
    last = (F.min_by if reverse else F.max_by)(F.struct(*cols), at)
    totals = done.groupBy(*part).agg(last.alias("_e")).select(*part, "_e.*")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_o=[tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in pdf[CHUNK]]).sort_values("_o", ascending=not reverse)
        acc, out = (1.0, 0.0, 0.0, 0.0, 0.0), []
        for row in pdf[cols].itertuples(index=False, name=None):
            out.append(acc)
            acc = compose(row, acc) if inner_first else compose(acc, row)
        pdf[cols] = np.array(out)
        return pdf.drop(columns="_o")

    carry = totals.groupBy(*keys).applyInPandas(across, totals.schema)  # one row per slice of the key
    x = join_keys(done, carry.withColumnsRenamed({c: f"_k{c}" for c in cols}), part)
    own, before = (lambda c: F.col(f"{prefix}{c}")), (lambda c: F.col(f"_k{prefix}{c}"))
    both = _compose_columns(own, before) if inner_first else _compose_columns(before, own)
    return x.withColumns({f"{prefix}{c}": v for c, v in both.items()}).drop(*[f"_k{c}" for c in cols], CHUNK)


def _element(df: DataFrame, prefix: str, A, b, C=0.0, eta=0.0, J=0.0) -> DataFrame:
    lit = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return df.withColumns({f"{prefix}{n}": lit(v) for n, v in zip(ELEMENT, (A, b, C, eta, J))})


def ewma_level(df: DataFrame, keys: list[str], t: str, tie: list[str], y: str, lam: float, life: str | None = None,
               lam_reset: float | None = None, out: str = "level", rows: int | None = None) -> DataFrame:
    """``level = lam*y + (1-lam)*level``; the first label sets it, and ``lam_reset`` applies to the first label of a new life."""
    o = Ordered(df, keys, t, tie, rows).running({"_p": ("lag", F.struct(F.lit(1).alias("x"), *([life] if life else [])))})
    x = o.result()
    lam_row = F.lit(float(lam))
    if life is not None and lam_reset is not None:
        lam_row = F.when(F.col(life) != F.col(f"_p.{life}"), float(lam_reset)).otherwise(lam_row)
    lam_row = F.when(F.col("_p").isNull(), 1.0).otherwise(lam_row)
    x = _element(x.withColumn("_l", lam_row), "_e", 1 - F.col("_l"), F.col("_l") * F.col(y))
    x = scan(x, keys, t, tie, "_e", rows=rows)
    return x.withColumn(out, F.col("_eb")).drop("_p", "_l", *[f"_e{c}" for c in ELEMENT])


# -- local level with fixed-lag smoothing -----------------------------------------------------------
def growth(dt_hours: Column, qh: Column, qj: Column) -> Column:
    """Variance added over a pause: proportional to its length, plus a jump when it is long."""
    return qh * dt_hours + F.when(dt_hours > GAP_HOURS, qj).otherwise(0.0)


def _level_element(df: DataFrame, prefix: str, q: Column, y: Column, first: Column) -> DataFrame:
    s = q + 1.0
    gain = q / s
    pick = lambda a, b: F.when(first, F.lit(float(a)) if not isinstance(a, Column) else a).otherwise(b)
    return _element(df, prefix, pick(0.0, 1 - gain), pick(y, gain * y), pick(1.0, (1 - gain) * q), pick(0.0, y / s), pick(0.0, 1.0 / s))


def local_level(labels: DataFrame, keys: list[str], t: str, tie: str, y: str, qh: Column, qj: Column, rows: int | None = None) -> DataFrame:
    """``m``, ``p``: filtered level and variance (in units of the measurement noise) after each label."""
    o = Ordered(labels, keys, t, [tie], rows).running({"_pt": ("lag", F.col(t))})
    dt = (F.col(t) - F.col("_pt")) / 3600.0
    x = _level_element(o.result(), "_f", growth(dt, qh, qj), F.col(y), F.col("_pt").isNull())
    x = scan(x, keys, t, [tie], "_f", rows=rows)
    return x.withColumns({"m": F.col("_fb"), "p": F.col("_fC")}).drop("_pt", *[f"_f{c}" for c in ELEMENT])


def innovations(filtered: DataFrame, keys: list[str], t: str, tie: str, y: str, qh: Column, qj: Column, rows: int | None = None) -> DataFrame:
    """One-step prediction errors and variances of a filtered label sequence (null on the first label)."""
    o = Ordered(filtered, keys, t, [tie], rows).running({"_b": ("lag", F.struct(F.col(t).alias("t"), "m", "p"))})
    dt = (F.col(t) - F.col("_b.t")) / 3600.0
    return o.with_df(o.df.withColumns({"innovation": F.col(y) - F.col("_b.m"), "s": F.col("_b.p") + growth(dt, qh, qj) + 1.0})).result("_b")


def likelihood(filtered: DataFrame, keys: list[str], t: str, tie: str, y: str, qh: Column, qj: Column, rows: int | None = None) -> DataFrame:
    """Concentrated log likelihood and noise scale per key, from the innovations."""
    x = innovations(filtered, keys, t, tie, y, qh, qj, rows)
    n, v = F.count("innovation"), F.avg(F.col("innovation") * F.col("innovation") / F.col("s"))
    return x.groupBy(*keys).agg(n.alias("n"), v.alias("noise"), (-0.5 * (n * F.log(v) + F.sum(F.log("s")))).alias("loglik"))


def likelihood_grid(labels: DataFrame, keys: list[str], t: str, tie: str, y: str, qhs: list[float], qjs: list[float], rows: int | None = None) -> DataFrame:
    """``likelihood`` of ``local_level`` for every (qh, qj) of a grid, one row per key and pair.

    All pairs are filtered side by side in the task that holds a slice of labels, so the labels are not copied for each pair. Of a slice
    only sums leave the task. Where a key is cut, the state that enters a slice comes from the elements of the slices before it.
    """
    grid = [(float(a), float(b)) for a in qhs for b in qjs]
    qh, qj = (np.array(v) for v in zip(*grid))
    o = Ordered(labels.select(*keys, t, tie, y), keys, t, [tie], rows).running({"_pt": ("lag", F.col(t))})
    part = o.part
    x = o.df.select(*part, t, tie, F.col(y).cast("double").alias("_y"), ((F.col(t) - F.col("_pt")) / 3600.0).cast("double").alias("_dt"), F.col("_pt").isNull().alias("_first"))
    schema = x.select(*part).schema

    def sorted_slices(df: DataFrame) -> DataFrame:
        return df.repartition(*part).sortWithinPartitions(*part, F.col("_state").isNull(), t, tie).withColumn("_group", F.to_json(F.struct(*part)))

    def per_slice(begin, step, end):
        """One array of numbers for each slice, from its rows in order; ``_state`` is set in a row before them."""
        def run(batches):
            last, acc, head = None, None, None
            row = lambda: pd.DataFrame([[*head, end(acc)]], columns=[*part, "_state"])
            for pdf in batches:
                for i, (group, state, v, dt, first) in enumerate(zip(pdf["_group"], pdf["_state"], pdf["_y"].to_numpy(float), pdf["_dt"].to_numpy(float), pdf["_first"])):
                    if group != last:
                        if last is not None:
                            yield row()
                        last, acc, head = group, begin(state), [pdf[c].iloc[i] for c in part]
                    if state is None:
                        step(acc, v, qh * dt + (qj if dt > GAP_HOURS else 0.0), first)
            if last is not None:
                yield row()
        return run

    def compose_row(acc, v, q, first):
        one = np.ones(len(grid))
        e = (0 * one, v * one, one, 0 * one, 0 * one) if first else (1 / (q + 1), q / (q + 1) * v, q / (q + 1), v / (q + 1), 1 / (q + 1))
        acc[:] = [e] if not acc else [compose(acc[0], e)]

    def filter_row(acc, v, q, first):
        m, p, sums = acc
        s, e = p + q + 1.0, v - m  # not a number where there is no label before
        has_e, has_s = ~np.isnan(e), ~np.isnan(s)
        both = has_e & has_s
        sums += (has_e, both, np.where(both, e * e / s, 0.0), has_s, np.where(has_s, np.log(s), 0.0))
        gain = (s - 1.0) / s
        acc[0], acc[1] = (np.full(len(grid), v), np.ones(len(grid))) if first else (m + gain * e, gain)

    out = StructType([*schema, *StructType.fromDDL("_state array<double>")])
    start = x.withColumn("_state", F.lit(None).cast("array<double>"))
    if o.split:
        total = sorted_slices(start).mapInPandas(per_slice(lambda state: [], compose_row, lambda acc: np.concatenate(acc[0])), out)
        order = lambda pdf: pdf.assign(_o=[tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in pdf[CHUNK]]).sort_values("_o").drop(columns="_o")

        def across(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, acc, entering = order(pdf), None, []
            for state in pdf["_state"]:
                entering.append(np.full(2 * len(grid), np.nan) if acc is None else np.concatenate([acc[1], acc[2]]))
                e = np.asarray(state).reshape(5, -1)
                acc = e if acc is None else compose(acc, e)
            return pdf.assign(_state=entering)

        carry = total.groupBy(*keys).applyInPandas(across, out)  # one row per slice of the key
        start = start.unionByName(carry, allowMissingColumns=True)
    begin = lambda state: [*(np.full((2, len(grid)), np.nan) if state is None else np.asarray(state, float).reshape(2, -1)), np.zeros((5, len(grid)))]
    done = sorted_slices(start).mapInPandas(per_slice(begin, filter_row, lambda acc: acc[2].T.ravel()), out)
    pairs = F.array(*[F.struct(F.lit(a).alias("qh"), F.lit(b).alias("qj"), F.slice("_state", 5 * i + 1, 5).alias("s")) for i, (a, b) in enumerate(grid)])
    z = done.select(*keys, F.explode(pairs).alias("_g")).groupBy(*keys, "_g.qh", "_g.qj").agg(*[F.sum(F.col("_g.s")[i]).alias(c) for i, c in enumerate(("n", "_nv", "_v", "_ns", "_s"))])
    noise = F.when(F.col("_nv") > 0, F.col("_v") / F.col("_nv"))
    return z.select(*keys, "qh", "qj", F.col("n").cast("bigint").alias("n"), noise.alias("noise"),
                    (-0.5 * (F.col("n") * F.log(noise) + F.when(F.col("_ns") > 0, F.col("_s")))).alias("loglik"))


def fixed_lag_smoother(queries: DataFrame, labels: DataFrame, keys: list[str], t: str, tie: str, y: str, qh: Column | float, qj: Column | float,
                       window: float, rows: int | None = None) -> DataFrame:
    """``fwd``, ``level``, ``level_var``: past filter, and its fusion with a backward filter over labels in ``(row, t + window]``.

    The backward window slides, so it is built from two parts of fixed blocks as long as the window: the rest of the
    row's own block and the start of the next one. Both parts are scans, whatever the number of labels in a window.
    Where ``qh`` and ``qj`` are numbers, no label repeats and those of every block fit in a task, a task scans a whole block.
    """
    if window > 0 and not isinstance(qh, Column) and not isinstance(qj, Column):
        known = labels.filter(F.col(t).isNotNull())
        blocks = known.select(*keys, F.floor(F.col(t) / float(window)).alias("_blk"))
        # scans order labels that repeat in their own way, so these stay with them
        once = not known.groupBy(F.xxhash64(*keys, t, tie).alias("_label")).count().filter("count > 1").head(1)
        if once and key_rows(blocks, [*keys, "_blk"]) == WHOLE:
            return _levels_of_blocks(queries, labels, keys, t, tie, y, float(qh), float(qj), window, rows)
    qh, qj = (c if isinstance(c, Column) else F.lit(float(c)) for c in (qh, qj))
    f = local_level(labels, keys, t, tie, y, qh, qj, rows)
    pay = {"m": F.col("m"), "p": F.col("p"), "t": F.col(t)}
    at = dict(rtie=F.col(tie), by_position=True, rows=rows)
    late = F.lit(2 ** 62)
    lt, ltie = (F.col(t), F.col(tie)) if window >= 0 else (F.col(t) + window, late)
    x = asof(queries, f, keys, lt, F.col(t), pay, "_f", "prev", ltie=ltie, **at)
    pf = F.col("_f.p") + growth((F.col(t) - F.col("_f.t")) / 3600.0, qh, qj)
    x = x.withColumns({"fwd": F.col("_f.m"), "_pf": pf}).drop("_f")
    if window <= 0:
        return x.withColumns({"level": F.col("fwd"), "level_var": F.col("_pf")}).drop("_pf")
    block = lambda c: F.floor(c / float(window))
    o = Ordered(labels, keys, t, [tie], rows).running({"_nt": ("lag", F.col(t))}, reverse=True)
    b = o.result().withColumn("_blk", block(F.col(t)))
    link = growth((F.col("_nt") - F.col(t)) / 3600.0, qh, qj)
    ends = F.col("_nt").isNull() | (block(F.col("_nt")) != F.col("_blk"))
    # _s: from the next block's state to this row; _i: starting fresh at the block's last label; _q: from this row's own start down to the block's first.
    b = _level_element(b, "_s", F.coalesce(link, F.lit(0.0)), F.col(y), F.lit(False))
    b = _level_element(b, "_i", F.coalesce(link, F.lit(0.0)), F.col(y), ends)
    group = [*keys, "_blk"]
    b = scan(b, group, t, [tie], "_s", reverse=True, rows=rows)
    b = scan(b, group, t, [tie], "_i", reverse=True, rows=rows)
    b = _level_element(b, "_q", F.coalesce(link, F.lit(0.0)), F.col(y), F.lit(False))
    # _q composes rows before this one only: scan, then take the previous row's value and start from this label.
    b = scan(b, group, t, [tie], "_q", inner_first=True, rows=rows)
    o = Ordered(b, group, t, [tie], rows).running({"_e": ("lag", F.struct(*[F.col(f"_q{c}").alias(c) for c in ELEMENT])),
                                                   "_t1": ("min", F.col(t))})
    e = lambda c: F.col(f"_e.{c}")
    m1, p1 = apply_element(F.col(y), F.lit(1.0), e)
    b = o.with_df(o.df.withColumns({"_pm": F.coalesce(m1, F.col(y)), "_pp": F.coalesce(p1, F.lit(1.0))})).result("_e")
    suf = {"blk": F.col("_blk"), "t": F.col(t), "im": F.col("_ib"), "ip": F.col("_iC"), **{c: F.col(f"_s{c}") for c in ELEMENT}}
    x = asof(x, b, keys, F.col(t), F.col(t), suf, "_n", "next", ltie=F.col(tie), **at)
    x = asof(x, b, keys, F.col(t) + float(window), F.col(t), {"blk": F.col("_blk"), "m": F.col("_pm"), "p": F.col("_pp"), "t1": F.col("_t1"), "t": F.col(t)},
             "_z", "prev", inclusive=True, ltie=late, **at)
    own = block(F.col(t))
    has_suffix = F.coalesce(F.col("_n.blk") == own, F.lit(False))
    has_prefix = F.coalesce(F.col("_z.blk") == own + 1, F.lit(False))
    sm, sp = apply_element(F.col("_z.m"), F.col("_z.p"), lambda c: F.col(f"_n.{c}"))
    mb = F.when(has_suffix & has_prefix, sm).when(has_suffix, F.col("_n.im")).when(has_prefix, F.col("_z.m"))
    pb = F.when(has_suffix & has_prefix, sp).when(has_suffix, F.col("_n.ip")).when(has_prefix, F.col("_z.p"))
    start = F.when(has_suffix, F.col("_n.t")).when(has_prefix, F.col("_z.t1"))
    x = x.withColumns({"_mb": mb, "_pb": pb + growth((start - F.col(t)) / 3600.0, qh, qj)}).drop("_n", "_z")
    w1, w2 = 1.0 / F.col("_pf"), 1.0 / F.col("_pb")
    fused = (w1 * F.col("fwd") + w2 * F.col("_mb")) / (w1 + w2)
    return x.withColumns({"level": F.coalesce(fused, F.col("fwd"), F.col("_mb")),
                          "level_var": F.coalesce(1.0 / (w1 + w2), F.col("_pf"), F.col("_pb"))}).drop("_pf", "_mb", "_pb")


def noise_grid(df: DataFrame, qhs: list[float], qjs: list[float]) -> DataFrame:
    """Every row under every (qh, qj) of a fixed grid."""
    combos = F.array(*[F.struct(F.lit(float(a)).alias("qh"), F.lit(float(b)).alias("qj")) for a in qhs for b in qjs])
    return df.withColumn("_g", F.explode(combos)).select("*", "_g.qh", "_g.qj").drop("_g")


def select_noise(queries: DataFrame, labels: DataFrame, keys: list[str], t: str, tie: str, y: str, qhs: list[float], qjs: list[float],
                 window: float, rows: int | None = None) -> DataFrame:
    """Per key the (qh, qj) with the least squared error of the smoothed level on the given development rows."""
    known = labels.filter(F.col(t).isNotNull()).select(*keys, F.floor(F.col(t) / float(window or 1.0)).alias("_blk"))
    if window > 0 and key_rows(known, [*keys, "_blk"]) == WHOLE:
        mse = _errors_of_blocks(queries, labels, keys, t, tie, y, qhs, qjs, window)
    else:  # the labels of one window do not fit in a task
        mse = _errors_of_copies(queries, labels, keys, t, tie, y, qhs, qjs, window, rows)
    return mse.groupBy(*keys).agg(F.min(F.struct("mse", "qh", "qj")).alias("_b")).select(*keys, "_b.qh", "_b.qj", "_b.mse")


def _errors_of_copies(queries, labels, keys, t, tie, y, qhs, qjs, window, rows) -> DataFrame:
    """Squared error of every pair, from rows copied for each pair and slices of their order."""
    x = fixed_lag_smoother(noise_grid(queries, qhs, qjs), noise_grid(labels, qhs, qjs), [*keys, "qh", "qj"], t, tie, y,
                           F.col("qh"), F.col("qj"), window, rows)
    e = F.col("level") - F.col(y)
    return x.groupBy(*keys, "qh", "qj").agg(F.round(F.avg(e * e), 9).alias("mse"))


def _scanned(acc: list[np.ndarray], join: Callable) -> list[np.ndarray]:
    """Each row of elements joined with all rows before it, by doubling."""
    acc, step = [x.copy() for x in acc], 1
    while step < len(acc[0]):
        for x, v in zip(acc, join([x[:-step] for x in acc], [x[step:] for x in acc])):
            x[step:] = v
        step *= 2
    return acc


def _updates(q: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Elements of a pause that adds ``q`` followed by a label."""
    s = q + 1.0
    return [1.0 / s, q / s * y, q / s, y / s, 1.0 / s]


def _pushed(m, p, e):
    d = 1.0 / (1.0 + p * e[4])
    return e[0] * d * (m + p * e[3]) + e[1], e[0] * e[0] * d * p + e[2]


def _blocks(queries: DataFrame, labels: DataFrame, keys: list[str], t: str, tie: str, y: str, qhs: list[float], qjs: list[float],
            window: float, carry: bool = False) -> tuple[DataFrame, list[str], Callable]:
    """(rows, their group, smoother of a group's rows): all pairs are smoothed side by side in the task that holds a block of time as long as the window.

    The labels that a row may see ahead lie in its own block and the next one, so a label goes to two tasks, whatever the number of
    pairs. The state that enters a block comes from one element for each block before it. Rows without a time are left out.
    The smoother gives the queries' places and labels, then for each slice of pairs the past filter, the level and its variance.
    ``carry`` brings the whole query rows along in ``_row``.
    """
    grid = [(float(a), float(b)) for a in qhs for b in qjs]
    QH, QJ = (np.array(v) for v in zip(*grid))
    group = [*keys, "_blk"]
    has_time, block = F.col(t).isNotNull(), F.floor(F.col(t) / float(window))

    def rows_of(df: DataFrame, kind: int, back: int = 0, more: list[Column] = ()) -> DataFrame:
        return df.filter(has_time).select(*keys, (block - back).alias("_blk"), F.lit(kind).alias("_kind"), F.col(t).cast("double").alias("_t"),
                                          F.col(tie).cast("bigint").alias("_tie"), F.col(y).cast("double").alias("_y"), *more)

    own, ahead, asked = rows_of(labels, 0), rows_of(labels, 1, 1), rows_of(queries, 2, more=[F.struct("*").alias("_row")] if carry else [])

    def added(seconds: np.ndarray, c: slice) -> np.ndarray:
        h = (seconds / 3600.0)[:, None]
        return QH[c] * h + np.where(h > GAP_HOURS, QJ[c], 0.0)

    def ordered(pdf: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = pdf[pdf["_kind"] == kind].sort_values(["_t", "_tie"], na_position="first")
        return x["_t"].to_numpy(float), x["_tie"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64), x["_y"].to_numpy(float)

    def parts(n: int) -> list[slice]:
        width = max(1, min(len(grid), 2_000_000 // max(n, 1)))  # pairs side by side: memory follows the rows of a block
        return [slice(i, i + width) for i in range(0, len(grid), width)]

    key_fields = list(labels.select(*keys).schema)
    total_type = StructType([*key_fields, *StructType.fromDDL("_blk long, _t0 double, _t1 double, _y0 double, _e array<double>")])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        """First and last time, first label, and the element of the labels after the first."""
        at, _, v = ordered(pdf, 0)
        row, e = [np.nan] * 3 + [None], []
        if len(at):
            for c in parts(len(at)):
                acc = [np.broadcast_to(x, (1, len(QH[c]))) for x in (1.0, 0.0, 0.0, 0.0, 0.0)]
                if len(at) > 1:
                    acc = _updates(added(np.diff(at), c), v[1:, None])
                while len(acc[0]) > 1:
                    two = len(acc[0]) // 2 * 2
                    acc = [np.concatenate([a, x[two:]]) for a, x in zip(compose([x[:two:2] for x in acc], [x[1:two:2] for x in acc]), acc)]
                e.append(np.stack([x[0] for x in acc]))
            row = [at[0], at[-1], v[0], np.concatenate(e, axis=1).ravel()]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in group), *row]], columns=total_type.names)

    # A label without a time comes before all others: it is seen until the first of them, without a variance.
    lead = labels.filter(~has_time).groupBy(*keys).agg(F.max_by(F.col(y).cast("double"), F.col(tie)).alias("_lead"), F.count(F.when(F.col(y).isNull(), 1)).alias("_bad"))
    # blocks are the work and their rows are small: dealt over all partitions, not merged by size
    spread = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    totals = spread(own.unionByName(asked.select(*group).dropDuplicates(), allowMissingColumns=True)).groupBy(*group).applyInPandas(total, total_type)
    state_type = StructType([*key_fields, *StructType.fromDDL("_blk long, _t double, _lost double, _m array<double>, _p array<double>")])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        lost = bool((pdf["_bad"].iloc[0] or 0) > 0)
        m, p, last, out = np.full(len(grid), pdf["_lead"].iloc[0], float), np.full(len(grid), np.nan), np.nan, []
        for t0, t1, y0, e in zip(pdf["_t0"], pdf["_t1"], pdf["_y0"], pdf["_e"]):
            out.append((last, m, p))
            if e is not None:
                m, p = first_state(m, p, last, t0, y0, slice(None), lost)
                m, p = _pushed(m, p, np.asarray(e).reshape(5, -1))
                last = t1
        return pdf[group].assign(_t=[x[0] for x in out], _lost=float((pdf["_bad"].iloc[0] or 0) > 0), _m=[x[1] for x in out], _p=[x[2] for x in out])

    def first_state(m, p, last, t0, y0, c, lost):
        if np.isnan(last):
            return np.full(len(m), np.nan if lost else y0), np.ones(len(m))
        q = p + added(np.array([t0 - last]), c)[0]
        return m + q / (q + 1.0) * (y0 - m), q / (q + 1.0)

    entering = join_keys(totals, lead, keys).groupBy(*keys).applyInPandas(across, state_type).withColumn("_kind", F.lit(3))

    def smoothed(pdf: pd.DataFrame):
        """The queries' labels in the order of (time, tie), then (pairs, past filter, level, variance) for each slice of pairs."""
        qt, qtie, qy = ordered(pdf, 2)
        yield qy
        if not len(qt):
            return
        (lt, ltie, ly), (nt, _, ny) = ordered(pdf, 0), ordered(pdf, 1)
        into = pdf[pdf["_kind"] == 3].iloc[0]
        n, k = len(lt), len(nt)
        both_t, both_tie = np.r_[lt, qt], np.r_[ltie, qtie]
        order = np.lexsort((both_tie, both_t))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.r_[True, (np.diff(both_t[order]) != 0) | (np.diff(both_tie[order]) != 0)])
        before, after = np.searchsorted(rank[:n], rank[n:], "left"), np.searchsorted(rank[:n], rank[n:], "right")
        seen = np.searchsorted(nt, qt + window, "right")  # labels of the next block in the window
        suffix, prefix = (after < n)[:, None], (seen > 0)[:, None]
        at, z = np.minimum(after, n - 1), np.maximum(seen - 1, 0)
        start = np.where(after < n, lt[at] if n else np.nan, nt[0] if k else np.nan)
        ft = np.r_[into["_t"], lt][before]
        for c in parts(n + k + len(qt)):
            wide = len(QH[c])
            m, p = np.asarray(into["_m"], float)[None, c], np.asarray(into["_p"], float)[None, c]
            none = np.full((1, wide), np.nan)
            one = [np.full((1, wide), x) for x in (1.0, 0.0, 0.0, 0.0, 0.0)]
            sm = sp = im = ip = none
            whole = [none] * 5
            if n:
                m0, p0 = first_state(m[0], p[0], into["_t"], lt[0], ly[0], c, into["_lost"])
                to, steps = [x for x in one], added(np.diff(lt), c)
                if n > 1:
                    to = [np.concatenate(x) for x in zip(one, _scanned(_updates(steps, ly[1:, None]), compose))]
                fm, fp = _pushed(m0, p0, to)
                m, p = np.concatenate([m, fm]), np.concatenate([p, fp])
                # backwards inside the block: from a fresh start at its last label, and from the next block's state
                rest = [x for x in one]
                if n > 1:
                    back = _scanned([x[::-1] for x in _updates(steps, ly[:-1, None])], compose)
                    rest = [np.concatenate([x[::-1], o]) for x, o in zip(back, one)]
                im, ip = _pushed(ly[-1], 1.0, rest)
                link = added(np.array([nt[0] - lt[-1]]), c) if k else np.zeros((1, wide))
                whole = compose(_updates(link, np.array([[ly[-1]]])), rest)
            zm = zp = none
            if k:
                way = [x for x in one]
                if k > 1:
                    inner = _scanned(_updates(added(np.diff(nt), c), ny[:-1, None]), lambda early, late: compose(late, early))
                    way = [np.concatenate(x) for x in zip(one, inner)]
                zm, zp = _pushed(ny[:, None], 1.0, way)
                zm = np.where(np.isnan(zm), ny[:, None], zm)  # a label missing below this one: its own value
            fwd = m[before]
            pf = p[before] + added(qt - ft, c)
            zmq, zpq = zm[z], zp[z]
            if n:
                sm, sp = _pushed(zmq, zpq, [x[at] for x in whole])
                im, ip = im[at], ip[at]
            mb = np.where(suffix & prefix, sm, np.where(suffix, im, np.where(prefix, zmq, np.nan)))
            pb = np.where(suffix & prefix, sp, np.where(suffix, ip, np.where(prefix, zpq, np.nan))) + added(start - qt, c)
            w1, w2 = 1.0 / pf, 1.0 / pb
            fused = (w1 * fwd + w2 * mb) / (w1 + w2)
            level = np.where(~np.isnan(fused), fused, np.where(~np.isnan(fwd), fwd, mb))
            var = 1.0 / (w1 + w2)
            yield c, fwd, level, np.where(~np.isnan(var), var, np.where(~np.isnan(pf), pf, pb))

    rows = own.unionByName(ahead).unionByName(asked, allowMissingColumns=True).unionByName(entering, allowMissingColumns=True)
    return spread(rows), group, smoothed


def _errors_of_blocks(queries: DataFrame, labels: DataFrame, keys: list[str], t: str, tie: str, y: str, qhs: list[float], qjs: list[float],
                      window: float) -> DataFrame:
    """The same with all pairs side by side in the task that holds a block; see :func:`_blocks`. Rows without a time have no error."""
    grid = [(float(a), float(b)) for a in qhs for b in qjs]
    rows, group, smoothed = _blocks(queries, labels, keys, t, tie, y, qhs, qjs, window)
    error_type = StructType([*labels.select(*keys).schema, *StructType.fromDDL("_n array<long>, _s array<double>")])

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        found = smoothed(pdf)
        qy = next(found)
        if not len(qy):
            return pd.DataFrame([], columns=error_type.names)
        count, square = np.zeros(len(grid), np.int64), np.zeros(len(grid))
        for c, _, level, _ in found:
            e = level - qy[:, None]
            count[c], square[c] = (~np.isnan(e)).sum(0), np.nansum(e * e, axis=0)
        return pd.DataFrame([[*(pdf[x].iloc[0] for x in keys), count, square]], columns=error_type.names)

    done = rows.groupBy(*group).applyInPandas(errors, error_type)
    pairs = F.array(*[F.struct(F.lit(a).alias("qh"), F.lit(b).alias("qj"), F.col("_n")[i].alias("n"), F.col("_s")[i].alias("s")) for i, (a, b) in enumerate(grid)])
    z = done.select(*keys, F.explode(pairs).alias("_g")).groupBy(*keys, "_g.qh", "_g.qj").agg(F.sum("_g.n").alias("_n"), F.sum("_g.s").alias("_s"))
    return z.select(*keys, "qh", "qj", F.when(F.col("_n") > 0, F.round(F.col("_s") / F.col("_n"), 9)).alias("mse"))


def _levels_of_blocks(queries: DataFrame, labels: DataFrame, keys: list[str], t: str, tie: str, y: str, qh: float, qj: float, window: float,
                      rows: int | None) -> DataFrame:
    """``fixed_lag_smoother`` with a block in one task; see :func:`_blocks`. A row crosses the network once, a label three times."""
    names = ["fwd", "level", "level_var"]
    parts, group, smoothed = _blocks(queries, labels, keys, t, tie, y, [qh], [qj], window, carry=True)

    def levels(table: pa.Table) -> pa.Table:
        pdf = table.drop_columns(["_row"]).to_pandas()
        asked = pdf[pdf["_kind"] == 2].sort_values(["_t", "_tie"], na_position="first").index.to_numpy()
        found = smoothed(pdf)
        next(found)
        columns = [np.concatenate(x).ravel() for x in zip(*[x[1:] for x in found])] if len(asked) else [np.zeros(0)] * 3
        return pa.table({"_row": table["_row"].take(pa.array(asked)), **{n: pa.array(v, from_pandas=True) for n, v in zip(names, columns)}})

    out_type = StructType([*parts.select("_row").schema, *StructType.fromDDL(", ".join(f"{n} double" for n in names))])
    out = parts.groupBy(*group).applyInArrow(levels, out_type).select("_row.*", *names)
    timeless = queries.filter(F.col(t).isNull())
    if timeless.head(1):  # they see labels without a time only
        out = out.unionByName(fixed_lag_smoother(timeless, labels.filter(F.col(t).isNull()), keys, t, tie, y, F.lit(qh), F.lit(qj), window, rows))
    return out


def trust_flags(df: DataFrame, active: str, age: str, n: str, members: list[str], stale: float = 8.0, disagree: float = 3.0,
                cold: int = 30) -> DataFrame:
    """no_active, stale, disagree and cold flags from run activity, history age and count, and member spread."""
    have = F.filter(F.array(*members), lambda v: v.isNotNull())
    k = F.size(have)
    mean = F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, v: a + v), k)
    df = df.withColumn("_mean", mean)
    var = F.try_divide(F.aggregate(have, F.lit(0.0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean"))), k)
    return df.withColumns({"no_active": ~F.coalesce(F.col(active) > 0, F.lit(False)), "stale": F.coalesce(F.col(age) > stale, F.lit(True)),
                           "disagree": F.coalesce((k > 1) & (F.sqrt(var) > disagree), F.lit(False)),
                           "cold": F.coalesce(F.col(n), F.lit(0)) < cold}).drop("_mean")
