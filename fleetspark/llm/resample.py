"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from . import caches

#: Buckets of hashed words and word pairs; counts travel in slices.
BUCKETS, SLICE = 1 << 16, 1 << 10
#: Added to every count, share of the documents that is drawn.
SMOOTHING, SHARE = 1.0, 0.8
#: Target ids up to this many are sent to all tasks instead of moving the texts to them.
FEW_IDS = 100_000
_U = np.uint64


def buckets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and each pair of neighbouring words, and the text it belongs to. A-Z become lower case."""
    words = [(t or b"").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(caches.WORDS.__getitem__, (w for ws in words for w in ws)), _U, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    pairs = flat[:-1] * _U(0x9E3779B97F4A7C15) + flat[1:] * _U(0xC2B2AE3D27D4EB4F) if len(flat) else flat
    same = owner[:-1] == owner[1:] if len(flat) else np.zeros(0, bool)
    all_ = np.concatenate([flat, pairs[same]])
    all_ ^= all_ >> _U(29)
    return ((all_ * _U(0xBF58476D1CE4E5B9)) >> _U(48)).astype(np.int64) % BUCKETS, np.concatenate([owner, owner[:-1][same]])


def models(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """For each bucket log p_target / p_raw, counted over all documents of both kinds.

    ``target``: ids of the target documents. Every task adds up its own rows; slices of its counts are added up by slice, so
    no task or driver holds more than the fixed number of buckets.
    """
    ids = cut(target.select(F.col(id_col).alias("_t")).filter("_t IS NOT NULL").distinct())
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text")).select(F.col("text"), "id")
    wanted = rows.join(ids.withColumnRenamed("_t", "id"), "id", "left_semi").select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("words")
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                total += np.bincount(buckets(batch.column(0).slice(s, 512).to_pylist())[0], minlength=BUCKETS)
        parts = total.reshape(-1, SLICE)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["slice", "counts"])

    kind, sums = "slice int, counts binary", []
    for texts in (wanted, rows.select("text")):
        total = np.zeros((BUCKETS // SLICE, SLICE), np.float64)
        for r in texts.mapInArrow(count, kind).repartition(BUCKETS // SLICE, "slice").mapInArrow(add, kind).collect():
            total[r["slice"]] += np.frombuffer(r["counts"], np.int64)
        flat = total.ravel() + SMOOTHING
        sums.append(np.log(flat / flat.sum()))
    return sums[0] - sums[1]


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """id, ``log_weight`` (log likelihood ratio of the whole text), ``gumbel_key`` and ``order_key`` (its order as an integer)."""
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("words")
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                batch = whole.slice(s, 512)
                b, owner = buckets(batch.column(1).to_pylist())
                weight = np.bincount(owner, model.value[b], batch.num_rows)
                u = np.array([(xxhash.xxh3_64_intdigest(str(i).encode(), seed) + 0.5) / 2.0**64 for i in batch.column(0).to_pylist()])
                key = weight - np.log(-np.log(u)) + 0.0
                bits = key.view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key), pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))],
                                                 names=["id", "log_weight", "gumbel_key", "order_key"])

    cols = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    return cols.mapInArrow(score, f"id {docs.schema[id_col].dataType.simpleString()}, log_weight double, gumbel_key double, order_key long")


def kth_largest(rows: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest value of a long column, by four passes that each settle 16 bits; 65,536 counts at most reach the driver."""
    if k <= 0:
        return None
    value = F.col(col).bitwiseXOR(F.lit(-(2**63)))  # unsigned order
    found = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(0xFFFF))
        same = F.lit(True) if shift == 48 else F.shiftrightunsigned(value, shift + 16) == F.lit(found)
        counts = {r["d"]: r["n"] for r in rows.filter(same).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= k:
                found = found << 16 | d
                break
            k -= counts[d]
        else:
            return None
    return (found ^ 2**63) - (2**64 if found ^ 2**63 >= 2**63 else 0)


def importance_resample(docs: DataFrame, target: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per document: id, ``log_weight``, ``gumbel_key``, ``selected``.

    The weight of a document is the ratio of its probability under the hashed n-gram model of the target documents to that
    under the model of all documents. Weights plus Gumbel noise, drawn by a hash of the id, are ranked, and the top ``share``
    of the rows is a sample without replacement in proportion to the weights. Both models count all documents.

    Null and empty texts have weight 0 (log); equal ids draw equal noise, and rows that tie with the last one drawn are
    all drawn. Without target documents all weights follow the smoothing alone. An empty table gives an empty one.
    """
    rows = cut(weigh(docs, models(docs, target, id_col, text_col), id_col, text_col, seed))
    last = kth_largest(rows, "order_key", round(share * rows.count()))
    chosen = F.lit(False) if last is None else F.col("order_key") >= F.lit(last)
    return rows.select(F.col("id").alias(id_col), "log_weight", "gumbel_key", chosen.alias("selected"))
