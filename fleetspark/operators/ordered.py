"""Ordered scans that stay parallel when one key holds most of the rows.

A window partitioned by a hot key runs in one task. Here a key with more rows than ``fleetspark.chunkRows`` is cut
into consecutive slices of its order ``(t, tie)``; windows run inside a slice and a small per-slice summary carries
the state across slices. Slices are a function of row values only, so retried tasks agree on them.
A key that is small enough stays whole and costs one ordinary window.
"""

from __future__ import annotations

from functools import reduce
from itertools import count, takewhile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import cut

CHUNK = "_chunk"
CHUNK_ROWS_CONF = "fleetspark.chunkRows"
DEFAULT_CHUNK_ROWS = 1_000_000
# A hot group has more than chunkRows rows, so there are at most total/chunkRows of them.
# Below this many they are broadcast as a literal table, above it they are joined by shuffle.
HOT_GROUPS_LITERAL = 20_000
# Pass as ``rows`` when ``key_rows`` has already shown that every key fits in one slice.
WHOLE = 0


def chunk_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(CHUNK_ROWS_CONF, str(DEFAULT_CHUNK_ROWS)))


def key_rows(df: DataFrame, keys: list[str], rows: int | None = None) -> int:
    """Check a base table once: WHOLE if no key has more than the slice size, else the slice size.

    Operators that chain several scans over rows derived from that table take the answer instead of checking again.
    """
    limit = rows or chunk_rows(df.sparkSession)
    return limit if df.groupBy(*keys).count().filter(F.col("count") > limit).head(1) else WHOLE


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi join that keeps the left key columns."""
    if not keys:
        return left.crossJoin(right)  # right is one row of totals
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r{i}"]) for i, k in enumerate(keys)])
    return left.join(renamed, cond, how).drop(*[f"_r{i}" for i in range(len(keys))])


class Ordered:
    """Rows of ``df`` ordered by ``(t, *tie)`` inside each key; hot keys are cut into slices."""

    def __init__(self, df: DataFrame, keys: list[str], t: str, tie: list[str] = (), rows: int | None = None):
        self.keys, self.t, self.tie = list(keys), t, list(tie)
        self.spark = df.sparkSession
        self.rows = rows or chunk_rows(self.spark)
        self.df = df if CHUNK in df.columns or rows == WHOLE else self._slice(df)
        self.split, self.stored = CHUNK in self.df.columns, False

    # -- slicing ---------------------------------------------------------------------------------
    def _slice(self, df: DataFrame) -> DataFrame:
        numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
        types = dict(df.dtypes)
        # the order's columns up to the first that cannot be cut by value
        order = [self.t, *takewhile(lambda c: types[c] in numeric, self.tie)]
        values = [F.col(c).cast("double") for c in order]
        low, high = [f"_slice_lo{i}" for i in range(len(order))], [f"_slice_hi{i}" for i in range(len(order))]
        levels: list[str] = []
        for level in count():
            group = self.keys + levels
            stats = [F.count(F.lit(1)).alias("_slice_n"), *[F.min(v).alias(a) for v, a in zip(values, low)], *[F.max(v).alias(b) for v, b in zip(values, high)]]
            limit = self.rows if level == 0 else 2 * self.rows
            spread = reduce(lambda a, b: a | b, [F.col(b) > F.col(a) for a, b in zip(low, high)])
            hot = df.groupBy(*group).agg(*stats).filter((F.col("_slice_n") > limit) & spread)
            found = hot.limit(HOT_GROUPS_LITERAL + 1).collect()
            if not found:
                break
            if len(found) <= HOT_GROUPS_LITERAL:
                hot = F.broadcast(self.spark.createDataFrame(found, hot.schema))
            parts = F.ceil(F.col("_slice_n") / self.rows)
            # rows are cut by the first column in which they still differ
            pos = F.coalesce(*[F.when(F.col(b) > F.col(a), (v - F.col(a)) / (F.col(b) - F.col(a))) for v, a, b in zip(values, low, high)])
            name = f"_level{level}"
            df = join_keys(df, hot, group).withColumn(
                name, F.coalesce(F.least(parts - 1, F.floor(pos * parts)), F.lit(-1)).cast("bigint")
            ).drop("_slice_n", *low, *high)
            levels.append(name)
        return df.withColumn(CHUNK, F.struct(*levels)).drop(*levels) if levels else df

    # -- windows ---------------------------------------------------------------------------------
    @property
    def part(self) -> list[str]:
        return self.keys + ([CHUNK] if self.split else [])

    def order(self, reverse: bool = False) -> list[Column]:
        cols = [F.col(c) for c in [self.t, *self.tie]]
        return [c.desc() for c in cols] if reverse else [c.asc() for c in cols]

    def window(self, reverse: bool = False):
        return Window.partitionBy(*self.part).orderBy(*self.order(reverse))

    def with_df(self, df: DataFrame) -> "Ordered":
        """Same order and slices over a transformed frame (the slice column must survive)."""
        out = object.__new__(Ordered)
        out.__dict__.update(self.__dict__)
        out.df, out.stored = df, False
        return out

    def _stored(self) -> "Ordered":
        out = self.with_df(cut(self.df))
        out.stored = True
        return out

    def running(self, specs: dict[str, tuple[str, Column]], reverse: bool = False, inclusive: bool = True) -> "Ordered":
        """Add running columns. kind is one of sum, count, min, max, last (non-null) or lag (previous row's value)."""
        w = self.window(reverse)
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = {}
        for name, (kind, col) in specs.items():
            if kind == "sum":
                local[name] = F.coalesce(F.sum(col).over(frame), F.lit(0))
            elif kind == "count":
                local[name] = F.count(col).over(frame)
            elif kind in ("min", "max"):
                local[name] = getattr(F, kind)(col).over(frame)
            elif kind == "last":
                local[name] = F.last(col, ignorenulls=True).over(frame)
            elif kind == "lag":
                local[name] = F.lag(F.struct(col.alias("v"))).over(w)
            else:
                raise ValueError(kind)
        if not self.split:
            df = self.df.withColumns(local)
            return self.with_df(self._unwrap(df, specs))
        if not self.stored:
            # The rows are read twice below (slices and their summary); without a stored stage a chain of
            # scans would recompute its input exponentially often.
            return self._stored().running(specs, reverse, inclusive)
        summary = self._carry(specs, reverse)
        df = join_keys(self.df.withColumns(local), F.broadcast(summary), self.part)
        for name, (kind, _) in specs.items():
            carry = F.col(f"_c_{name}")
            if kind in ("sum", "count"):
                value = F.col(name) + F.coalesce(carry, F.lit(0))
            elif kind == "min":
                value = F.least(F.col(name), carry)
            elif kind == "max":
                value = F.greatest(F.col(name), carry)
            else:
                value = F.coalesce(F.col(name), carry)
            df = df.withColumn(name, value)
        return self.with_df(self._unwrap(df.drop(*[f"_c_{n}" for n in specs]), specs))

    @staticmethod
    def _unwrap(df: DataFrame, specs) -> DataFrame:
        lags = {n: F.col(n)["v"] for n, (kind, _) in specs.items() if kind == "lag"}
        return df.withColumns(lags) if lags else df

    def _carry(self, specs, reverse: bool) -> DataFrame:
        """State entering each slice: one row per slice that has one before it, scanned in slice order.

        Only keys that were cut have such slices, some rows/chunkRows of them, so they are broadcast and the rows stay where they are.
        """
        ordering = F.struct(*[F.col(c) for c in [self.t, *self.tie]])
        pick = F.min_by if reverse else F.max_by
        aggs, scans = [], []
        seq = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
        before = Window.partitionBy(*self.keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        for name, (kind, col) in specs.items():
            s = f"_s_{name}"
            if kind in ("sum", "count"):
                aggs.append(getattr(F, kind)(col).alias(s))
                scans.append(F.sum(s).over(before).alias(f"_c_{name}"))
            elif kind in ("min", "max"):
                aggs.append(getattr(F, kind)(col).alias(s))
                scans.append(getattr(F, kind)(s).over(before).alias(f"_c_{name}"))
            else:
                value = F.struct(col.alias("v")) if kind == "lag" else col
                aggs.append(pick(value, F.when(value.isNotNull(), ordering)).alias(s))
                scans.append(F.last(s, ignorenulls=True).over(before).alias(f"_c_{name}"))
        nth = F.count(F.lit(1)).over(before).alias("_nth")
        return self.df.groupBy(*self.part).agg(*aggs).select(*self.part, *scans, nth).filter("_nth > 0").drop("_nth")

    def result(self, *drop: str) -> DataFrame:
        return self.df.drop(CHUNK, *drop)


class Frames:
    """Row-number frames: every row sees ``back`` rows before and ``ahead`` rows after it.

    A hot key is cut into blocks of row numbers and each block borrows the rows just outside it (the halo), so a
    frame never leaves its task. ``result`` drops the borrowed copies.
    """

    def __init__(self, df: DataFrame, keys: list[str], t: str, tie: list[str] = (), back: int = 0, ahead: int = 0,
                 rows: int | None = None):
        o = Ordered(df, keys, t, tie, rows)
        self.keys = list(keys)
        o = o.running({"_rn": ("count", F.lit(1))})
        self.split = o.split
        if not self.split:
            self.df, self.part = o.df, list(keys)
            return
        size = max(o.rows, back, ahead)
        pos = F.col("_rn") - 1
        block, at = F.floor(pos / size), pos % size
        copies = [F.struct(block.alias("b"), F.lit(False).alias("h"))]
        if back:
            copies.append(F.when(at >= size - back, F.struct((block + 1).alias("b"), F.lit(True).alias("h"))))
        if ahead:
            copies.append(F.when((at < ahead) & (block > 0), F.struct((block - 1).alias("b"), F.lit(True).alias("h"))))
        self.df = (o.df.drop(CHUNK)
                   .withColumn("_copy", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
                   .withColumns({"_block": F.col("_copy.b"), "_halo": F.col("_copy.h")}).drop("_copy"))
        self.part = self.keys + ["_block"]

    def window(self, reverse: bool = False):
        rn = F.col("_rn")
        return Window.partitionBy(*self.part).orderBy(rn.desc() if reverse else rn.asc())

    def result(self, df: DataFrame, *drop: str) -> DataFrame:
        if self.split:
            df = df.filter(~F.col("_halo"))
        return df.drop("_rn", "_block", "_halo", *drop)
