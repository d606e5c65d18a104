"""Paired block bootstrap of two models' squared errors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def block_sums(df: DataFrame, block: str, e_new: str, e_old: str) -> DataFrame:
    """Per block: row count and summed errors."""
    return df.groupBy(F.col(block).alias("k")).agg(F.sum(e_new).alias("s_new"), F.sum(e_old).alias("s_old"), F.count(F.lit(1)).alias("cnt"))


#: P(X <= k) of a Poisson variable with mean 1, k = 0, 1, ...; further terms are below the draws' 53 bits.
POISSON = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(18)]
#: The multipliers of a 64-bit finalizer.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Blocks whose draws are made at once.
BLOCKS = 2048


def times_drawn(keys: np.ndarray, replicates: int) -> np.ndarray:
    """How often each replicate (column) draws each block (row): Poisson(1) by mixed bits of the block's key and the replicate."""
    z = keys[:, None] ^ (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for m in MIX:
        z = (z ^ (z >> np.uint64(30))) * np.uint64(m)
    z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) / 2.0**53, "right")


def resample(blocks: DataFrame, replicates: int, seed: str = "boot") -> DataFrame:
    """One row per replicate: resampled mean errors.

    Each replicate uses each block a Poisson(1) number of times, drawn from a hash of the block, so blocks are drawn where they lie. A
    task keeps one sum per replicate and adds blocks to it; only these vectors are shuffled. Retried tasks draw the same.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, replicates))
        for batch in batches:
            key = np.array([int(h, 16) for h in batch.column(0).to_pylist()], np.uint64)
            sums = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], float)
            for s in range(0, len(key), BLOCKS):
                total += sums[:, s:s + BLOCKS] @ times_drawn(key[s:s + BLOCKS], replicates)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), *[pa.array(t) for t in total]], names=["rep", "s_new", "s_old", "cnt"])

    key = F.substring(F.md5(F.concat_ws("_", F.col("k").cast("string"), F.lit(seed)).cast("binary")), 1, 16)
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("s_new", "s_old", "cnt")]
    parts = blocks.select(key.alias("h"), *cols).mapInArrow(add, "rep int, s_new double, s_old double, cnt double")
    mean = lambda c: F.try_divide(F.sum(c), F.sum("cnt"))
    return parts.groupBy("rep").agg(mean("s_new").alias("m_new"), mean("s_old").alias("m_old")).withColumn("delta", F.col("m_new") - F.col("m_old"))


def paired_bootstrap(df: DataFrame, block: str, e_new: str, e_old: str, replicates: int, seed: str = "boot") -> DataFrame:
    """One row: MSE, its standard error, difference, its standard error, 95 % interval, and share of replicates below zero."""
    blocks = block_sums(df, block, e_new, e_old)
    reps = resample(blocks, replicates, seed)
    point = blocks.agg(F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("n_blocks"), (F.sum("s_new") / F.sum("cnt")).alias("mse"),
                       ((F.sum("s_new") - F.sum("s_old")) / F.sum("cnt")).alias("delta"))
    spread = reps.agg(F.stddev_pop("m_new").alias("mse_se"), F.stddev_pop("delta").alias("delta_se"),
                      F.avg(F.when(F.col("delta") < 0, 1.0).otherwise(0.0)).alias("p_delta_lt0"))
    ci = quantiles(reps, [], ["delta"], {"lo": 0.025, "hi": 0.975})
    return point.crossJoin(spread).crossJoin(ci)  # one row each
