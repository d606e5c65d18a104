"""The table of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Decimal places of every double that a query returns; a twin may name other ones for a column.
PLACES = 6
#: Added before rounding, the same everywhere: means of values with few decimals end in exact halves, which two engines may
#: round either way after different last bits.
NUDGE = 1.23e-8


class Twin(str):
    """SQL text with the decimal places of the columns that need others than ``PLACES``."""

    places: dict[str, int] = {}


def twin(text: str, places: dict[str, int]) -> Twin:
    out = Twin(text)
    out.places = places
    return out


def checked(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Doubles rounded to fixed places and counts as bigint, so both engines print the same values."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double") + NUDGE, places.get(name, PLACES))
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf: checked(fn(spark, sf), getattr(oracle, "places", {}))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register
