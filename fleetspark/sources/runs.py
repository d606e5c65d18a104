"""Run sensor files per split, their labels, unions and validated joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordered import join_keys
from ..operators.runs import OUTLIER
from .telemetry import read_by_name


def read_runs(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """All splits' CSV files, columns by name and cast to the declared schema, and a ``split`` column."""
    kinds = StructType.fromDDL(schema)
    parts = []
    for split, path in paths.items():
        raw = read_by_name(spark, path, [])
        cols = [(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds]
        parts.append(raw.select(*cols, F.lit(split).alias("split")))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns missing from a part become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def attach_labels(runs: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Left join of labels, with ``outlier`` for training labels above the plausible limit."""
    out = join_keys(runs, labels.select(*keys, label), keys)
    return out.withColumn("outlier", (F.col("split") == "train") & F.coalesce(F.col(label) > OUTLIER, F.lit(False)))


def align_to(table: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``df`` for every row of ``table``; its own row id column keeps the order."""
    return join_keys(table, df, keys)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], checks: dict[str, float]) -> DataFrame:
    """Inner join that raises on duplicate keys, unmatched rows, or paired columns that differ by more than the tolerance."""
    for df in (left, right):
        if df.groupBy(*keys).count().filter("count > 1").head(1):
            raise ValueError("keys are not unique")
    both = left.join(right.withColumnsRenamed({c: f"{c}_r" for c in checks}), keys, "full_outer")
    bad = reduce(lambda a, b: a | b, [~F.coalesce(F.abs(F.col(c) - F.col(f"{c}_r")) <= tol, F.lit(False)) for c, tol in checks.items()])
    if both.filter(bad).head(1):
        raise ValueError("joined values disagree")
    return both


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).dropDuplicates(), keys, "left_anti")


def common_columns(parts: list[DataFrame]) -> list[str]:
    """Columns present in every part, in the first part's order."""
    rest = [set(p.columns) for p in parts[1:]]
    return [c for c in parts[0].columns if all(c in r for r in rest)]
