"""Trailing row-count windows in linear time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Frames

# Up to this many rows a sliding frame is cheaper than the prefix/suffix form.
DIRECT_ROWS = 64


def rolling_stats(df: DataFrame, keys: list[str], t: str, tie: list[str], specs: list[tuple[str, str, int]],
                  stats: tuple[str, ...] = ("mean", "std", "min", "max", "dev"), rows: int | None = None) -> DataFrame:
    """Add ``{col}_{stat}_{name}`` for every ``(col, name, width)``; nulls are skipped, one value is enough.

    Sums use prefix sums of values centred per block; minima and maxima use prefix/suffix scans of blocks of ``width``.
    Wide windows therefore cost O(rows), not O(rows * width).
    """
    widest = max(w for _, _, w in specs)
    f = Frames(df, keys, t, tie, back=widest, rows=rows)
    out, temps = f.df, []
    for c in dict.fromkeys(c for c, _, w in specs if w > DIRECT_ROWS):
        if {"mean", "std", "sum", "count", "dev"} & set(stats):
            y = F.col(c) - F.col(f"_mid_{c}")
            prefix = f.window().rowsBetween(Window.unboundedPreceding, 0)
            # Centre on the block's first value: close enough for precision, and never a value from the future.
            whole = f.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out = out.withColumn(f"_mid_{c}", F.first(c, ignorenulls=True).over(whole))
            out = out.withColumns({f"_p1_{c}": F.coalesce(F.sum(y).over(prefix), F.lit(0.0)),
                                   f"_p2_{c}": F.coalesce(F.sum(y * y).over(prefix), F.lit(0.0)),
                                   f"_p0_{c}": F.count(c).over(prefix)})
            temps += [f"_mid_{c}", f"_p0_{c}", f"_p1_{c}", f"_p2_{c}"]
    for c, name, w in specs:
        if w <= DIRECT_ROWS:
            cols = _direct(c, name, f.window().rowsBetween(-(w - 1), 0), stats)
        else:
            cols, out, used = _wide(f, out, c, name, w, stats)
            temps += used
        out = out.withColumns(cols)
    return f.result(out, *temps)


def _direct(c: str, name: str, frame, stats) -> dict[str, Column]:
    col = F.col(c)
    made = {"mean": lambda: F.avg(col).over(frame), "std": lambda: F.stddev_samp(col).over(frame),
            "min": lambda: F.min(col).over(frame), "max": lambda: F.max(col).over(frame),
            "sum": lambda: F.sum(col).over(frame), "count": lambda: F.count(col).over(frame),
            "dev": lambda: col - F.avg(col).over(frame)}
    return {f"{c}_{s}_{name}": made[s]() for s in stats}


def _wide(f: Frames, out: DataFrame, c: str, name: str, w: int, stats):
    seq = f.window()
    cols: dict[str, Column] = {}
    temps: list[str] = []
    if {"mean", "std", "sum", "count", "dev"} & set(stats):
        diff = {i: F.col(f"_p{i}_{c}") - F.coalesce(F.lag(f"_p{i}_{c}", w).over(seq), F.lit(0)) for i in (0, 1, 2)}
        tag = f"{c}_{w}"
        out = out.withColumns({f"_w{i}_{tag}": d for i, d in diff.items()})
        temps += [f"_w{i}_{tag}" for i in (0, 1, 2)]
        n, s1, s2 = (F.col(f"_w{i}_{tag}") for i in (0, 1, 2))
        mean = F.when(n > 0, F.col(f"_mid_{c}") + s1 / n)
        made = {"mean": mean, "dev": F.col(c) - mean, "count": n,
                "sum": F.when(n > 0, s1 + n * F.col(f"_mid_{c}")),
                "std": F.when(n > 1, F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1)))}
        cols.update({f"{c}_{s}_{name}": made[s] for s in stats if s in made})
    if {"min", "max"} & set(stats):
        sub = f"_sub_{w}"
        if sub not in out.columns:
            out = out.withColumn(sub, F.floor((F.col("_rn") - 1) / w))
        inside = Window.partitionBy(*f.part, sub)
        up = inside.orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
        down = inside.orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
        for s in ("min", "max"):
            if s not in stats:
                continue
            agg, pick = getattr(F, s), (F.least if s == "min" else F.greatest)
            head, tail = f"_{s}h_{c}_{w}", f"_{s}t_{c}_{w}"
            out = out.withColumns({head: agg(c).over(up), tail: agg(c).over(down)})
            cols[f"{c}_{s}_{name}"] = pick(F.col(head), F.lag(tail, w - 1).over(seq))
            temps += [head, tail]
        temps.append(sub)
    return cols, out, list(dict.fromkeys(temps))


def rolling_event_count(df: DataFrame, keys: list[str], t: str, tie: list[str], flags: dict[str, str],
                        widths: dict[str, int], rows: int | None = None) -> DataFrame:
    """``n_{flag}_{name}``: how many of the last ``width`` rows (current included) carry the flag."""
    f = Frames(df, keys, t, tie, back=max(widths.values()), rows=rows)
    seq = f.window()
    prefix = seq.rowsBetween(Window.unboundedPreceding, 0)
    out = f.df.withColumns({f"_e_{n}": F.sum(F.when(F.col(c), 1).otherwise(0)).over(prefix) for n, c in flags.items()})
    out = out.withColumns({f"n_{n}_{name}": F.col(f"_e_{n}") - F.coalesce(F.lag(f"_e_{n}", w).over(seq), F.lit(0))
                           for n in flags for name, w in widths.items()})
    return f.result(out, *[f"_e_{n}" for n in flags])
