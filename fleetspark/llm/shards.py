"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .frames import draw, group_key, rank_in_groups


def interleave(docs: DataFrame, n_shards: int = 8, seed: str = "shards", id_col: str = "doc_id", stratum_col: str = "source",
               carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, the ``carry`` columns, ``stratum``, ``position``, ``shard`` and ``slot``.

    Rows are shuffled by a seeded hash inside their stratum; the row of rank r among n gets the fraction (r + 1/2) / n; all
    rows are ordered by fraction and the order is cut into ``n_shards`` runs whose lengths differ by one at most, so that
    each shard, and each stretch of it, holds the strata in their overall proportion.

    Null strata are a stratum of their own. Null ids take part; equal ids are ordered by the carried values. Rows that
    are equal in all of these are interchangeable. Texts are not read. An empty table gives an empty one; with fewer rows than
    shards some shards stay empty.
    """
    carry = carry or {}
    rows = docs.select(docs[id_col].alias("id"), group_key(docs[stratum_col]).alias("_s"), docs[stratum_col].alias("stratum"),
                       draw(seed, docs[id_col]).alias("_u"), *[c.alias(f"c_{n}") for n, c in carry.items()])
    ties = ["id", *[f"c_{n}" for n in carry]]
    rows = cut(rows)
    n = rows.count()
    ranked = rank_in_groups(rows, "_s", "_u", ties).withColumn("_f", (F.col("_rank") + 0.5) / F.col("_size")).drop("_rank", "_size")
    ranked = rank_in_groups(cut(ranked), None, "_f", ["_u", *ties], rows=n)
    shard = F.expr(f"(_rank * {n_shards}L) div {max(n, 1)}L")
    first = F.expr(f"(_shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("_shard", shard).select(
        F.col("id").alias(id_col), *[F.col(f"c_{k}").alias(k) for k in carry], "stratum", F.col("_rank").alias("position"),
        F.col("_shard").cast("int").alias("shard"), (F.col("_rank") - first).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The documents as one folder per shard, each file in slot order."""
    places = placed.select(F.col(id_col).alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = docs.select(*[docs[f"`{c}`"] for c in keep]).join(places, F.col(f"`{id_col}`").eqNullSafe(F.col("_id"))).drop("_id")
    out = out.withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    out.repartition("shard", F.floor(F.col("slot") / F.lit(100_000))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
