"""As-of lookups, range counts and nearest-k lists over ordered keys, without pairwise joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Frames, Ordered, join_keys


def _null_like(df: DataFrame, c: str) -> Column:
    return F.lit(None).cast(df.schema[c].dataType)


def asof(left: DataFrame, right: DataFrame, keys: list[str], lt: Column, rt: Column, payload: dict[str, Column],
         out: str = "hit", side: str = "prev", inclusive: bool = False, ltie: Column | None = None,
         rtie: Column | None = None, by_position: bool = False, rows: int | None = None) -> DataFrame:
    """Left rows plus ``out`` = payload struct of the closest right row before (or after) ``lt``.

    ``inclusive`` also accepts an equal position. Positions are times; ``by_position`` compares ``(time, tie)``.
    ``rtie`` orders right rows that share a time.
    The two inputs are merged in order and the last non-null payload is carried along; the sort key is split when hot.
    """
    zero = F.lit(0)
    # Scan order at an equal position decides whether an equal right row is seen before the left row.
    right_first = inclusive if side == "prev" else not inclusive
    tl, tr = (1, 0) if right_first else (0, 1)
    lcols = [F.col(k) for k in keys]
    L = left.select(*lcols, lt.cast("double").alias("_t"), (ltie if ltie is not None else zero).cast("bigint").alias("_tie"),
                    F.lit(tl).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    R = right.select(*lcols, rt.cast("double").alias("_t"), (rtie if rtie is not None else zero).cast("bigint").alias("_tie"),
                     F.lit(tr).alias("_side"), F.struct(*[v.alias(n) for n, v in payload.items()]).alias("_pay"))
    both = L.unionByName(R, allowMissingColumns=True)
    o = Ordered(both, keys, "_t", ["_tie", "_side"] if by_position else ["_side", "_tie"], rows)
    o = o.running({out: ("last", F.col("_pay"))}, reverse=side == "next")
    return o.df.filter(F.col("_row").isNotNull()).select("_row.*", F.col(out))


def recent_lists(df: DataFrame, keys: list[str], t: str, tie: list[str], item: dict[str, Column], back: int = 0,
                 ahead: int = 0, rows: int | None = None) -> DataFrame:
    """``_back``: the last ``back`` rows up to this one (oldest first); ``_ahead``: this one and the next ones."""
    f = Frames(df, keys, t, tie, max(back - 1, 0), max(ahead - 1, 0), rows)
    s = F.struct(*[v.alias(n) for n, v in item.items()])
    cols = {}
    if back:
        cols["_back"] = F.collect_list(s).over(f.window().rowsBetween(-(back - 1), 0))
    if ahead:
        cols["_ahead"] = F.collect_list(s).over(f.window().rowsBetween(0, ahead - 1))
    return f.result(f.df.withColumns(cols))


def range_counts(df: DataFrame, keys: list[str], t: str, ids: list[str], specs: dict[str, tuple],
                 value: str | None = None, source: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Rows of ``source`` (default: the input itself) in a time range around each row: one row per id.

    specs: ``name -> (low, low_closed, high, high_closed)``, offsets in the unit of ``t`` or columns.
    A range is the difference of two prefix counts, read by probes merged into the ordered rows, so its cost does
    not depend on how many rows fall into it. With ``value`` also ``{name}_sum``.
    """
    source = df if source is None else source
    probes = []
    for name, (lo, lo_in, hi, hi_in) in specs.items():
        for which, off, at in (("lo", lo, 0 if lo_in else 2), ("hi", hi, 2 if hi_in else 0)):
            x = F.col(t) + (off if isinstance(off, Column) else F.lit(float(off)))
            probes.append(F.struct(F.lit(f"{name}|{which}").alias("p"), x.cast("double").alias("x"), F.lit(at).alias("s")))
    P = df.select(*keys, *ids, F.explode(F.array(*probes)).alias("_p"))
    P = P.select(*keys, *ids, F.col("_p.p").alias("_p"), F.col("_p.x").alias("_t"), F.col("_p.s").alias("_side"))
    val = F.lit(1.0) if value is None else F.col(value).cast("double")
    D = source.select(*keys, *[_null_like(df, i).alias(i) for i in ids], F.lit(None).cast("string").alias("_p"),
                      F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), val.alias("_v"))
    both = P.withColumn("_v", F.lit(None).cast("double")).unionByName(D)
    o = Ordered(both, keys, "_t", ["_side"], rows)
    o = o.running({"_n": ("count", F.col("_v")), "_s": ("sum", F.col("_v"))})
    got = o.df.filter(F.col("_p").isNotNull())
    aggs = []
    for name in specs:
        at = lambda which, c: F.sum(F.when(F.col("_p") == f"{name}|{which}", F.col(c)))
        aggs.append(F.greatest(at("hi", "_n") - at("lo", "_n"), F.lit(0)).alias(name))
        if value is not None:
            aggs.append((at("hi", "_s") - at("lo", "_s")).alias(f"{name}_sum"))
    return got.groupBy(*ids).agg(*aggs)


def with_range_counts(df: DataFrame, keys, t, ids, specs, **kw) -> DataFrame:
    return join_keys(df, range_counts(df, keys, t, ids, specs, **kw), ids)


def nearest_k(left: DataFrame, right: DataFrame, keys: list[str], t: str, tie: str, item: dict[str, Column], k: int,
              rows: int | None = None) -> DataFrame:
    """Left rows plus ``_before`` and ``_after``: up to ``k`` right rows on each side in ``(t, tie)`` order, self excluded.

    Each list runs from the closest row outwards. Items must carry ``t`` and ``tie`` if they are to be ranked later.
    """
    R = recent_lists(right, keys, t, [tie], item, k, k, rows)
    at = dict(lt=F.col(t), rt=F.col(t), ltie=F.col(tie), rtie=F.col(tie), by_position=True, rows=rows)
    out = asof(left, R, keys, payload={"l": F.reverse("_back")}, out="_before", side="prev", **at)
    out = asof(out, R, keys, payload={"l": F.col("_ahead")}, out="_after", side="next", **at)
    none = {c: F.array().cast(out.select(f"{c}.l").schema[0].dataType) for c in ("_before", "_after")}
    return out.withColumns({c: F.coalesce(F.col(f"{c}.l"), none[c]) for c in none})


def mean_of(lst, field: str, n: int) -> Column:
    """Mean of the first ``n`` items of a list; null when it is empty or missing."""
    vals = F.transform(F.slice(lst, 1, n), lambda x: x[field])
    size = F.size(vals)
    return F.when(size > 0, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / size)
