"""Small helpers shared by the operators: local bindings, seeded draws, ranks inside possibly huge groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one cell of a group holds on average; ranks sort one cell at a time.
CELL_ROWS = 4096
_HEX13 = float(16**13)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def draw(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the values only, so retries agree. Nulls are left out."""
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_HEX13)


def group_key(c: Column) -> Column:
    """A string key without nulls: null and the empty string stay different."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


def text_mark(c: Column) -> Column:
    """16 bytes that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(c.cast("binary"), F.lit(b""))))


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns but maps, which have no order."""
    return F.xxhash64(*[df[f"`{f.name}`"] for f in df.schema if "map<" not in f.dataType.simpleString()])


def utf8_size(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def rank_in_groups(df: DataFrame, group: str | None, uniform: str, ties: list[str], weight: str | None = None,
                   cell_rows: int = CELL_ROWS, rows: int | None = None) -> DataFrame:
    """Adds ``_rank`` (from 0), ``_size`` of the group and, with ``weight``, ``_upto`` (running sum, own row included).

    Order inside a group: ``uniform`` (a number in [0, 1) spread evenly), then ``ties``. A group is cut by ``uniform``
    into cells of about ``cell_rows`` rows; each cell is ranked alone and starts from the summed counts of the cells before
    it. So a group with a third of all rows spreads over all tasks, and only one count per cell meets in one place.
    ``df`` is read three times: store it before if it is costly. ``rows`` gives the size where there is no group.
    """
    keys = [group] if group else []
    if group:
        sized = df.join(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), group)
    else:
        sized = df.withColumn("_size", F.lit(df.count() if rows is None else rows).cast("long"))
    cells = F.ceil(F.col("_size") / F.lit(cell_rows))
    sized = sized.withColumn("_cell", F.least(F.floor(F.col(uniform) * cells), cells - 1).cast("long"))
    sized = sized.repartition(*keys, "_cell")  # else the tasks of the join by group would also rank it
    sums = [F.count(F.lit(1)).alias("_c")] + ([F.sum(weight).alias("_w")] if weight else [])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy(*keys, "_cell").agg(*sums)
    starts = starts.select(*keys, "_cell", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"),
                           *([F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0")] if weight else []))
    inside = Window.partitionBy(*keys, "_cell").orderBy(uniform, *ties)
    out = sized.join(starts, [*keys, "_cell"]).withColumn("_rank", F.col("_c0") + F.row_number().over(inside) - 1)
    if weight:
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("_upto", F.col("_w0") + F.sum(weight).over(upto)).drop("_w0")
    return out.drop("_cell", "_c0")
