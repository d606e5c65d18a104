"""Structured Streaming twins of the telemetry operators, over a file source."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..scratch import new_path


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


class Feed:
    """A folder that a file stream reads one file at a time, filled piece by piece."""

    def __init__(self, spark: SparkSession, schema):
        self.folder, self.schema, self.spark = new_path(spark, "feed"), schema, spark

    def add(self, piece: DataFrame) -> None:
        piece.select(*self.schema.names).coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self) -> DataFrame:
        return file_stream(self.spark, self.folder, self.schema, files_per_trigger=1)


def run_available(df: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None, place: str | None = None) -> tuple[StreamingQuery, str]:
    """Process everything available and stop. Every micro-batch is written under its own number, so a retried one replaces itself.

    ``place`` (offsets and output) lets a later call go on where an earlier one stopped.
    """
    spark = df.sparkSession
    place = place or new_path(spark, "stream")
    out = f"{place}/out"
    sink = each or (lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    q = (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{place}/offsets")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q, out


def results(df: DataFrame, mode: str, place: str | None = None) -> DataFrame:
    """Output of a finished run: all appended batches."""
    _, out = run_available(df, mode, place=place)
    return df.sparkSession.read.schema(df.schema.add("batch", "long")).parquet(out).drop("batch")


def in_pieces(make: Callable[[DataFrame], DataFrame], feed: Feed, pieces: list[DataFrame], each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Feed the pieces as files, one micro-batch each, with a stop and restart half way; the appended output, or None with ``each``."""
    place, half = new_path(feed.spark, "stream"), len(pieces) // 2
    for part in (pieces[:half], pieces[half:]):
        for p in part:
            feed.add(p)
        df = make(feed.stream())
        _, out = run_available(df, "append", each, place)
    if each:
        return None
    return feed.spark.read.schema(df.schema.add("batch", "long")).parquet(out).drop("batch")


def as_timestamp(c: str) -> Column:
    """Epoch seconds as an event-time column."""
    return F.timestamp_micros((F.col(c) * 1e6).cast("bigint"))


def window_stats(stream: DataFrame, key: str, ts: str, cols: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding event-time statistics per key."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return stream.withWatermark(ts, late).groupBy(win.alias("w"), key).agg(*aggs).select(
        key, F.unix_micros("w.start").alias("start_us"), "n_samples", *[f"{c}_{s}" for c in cols for s in ("mean", "std", "min", "max")])


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of rows without a pause longer than ``gap``."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.max(ts).alias("_last")).select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("_last").alias("last_us"), "n")


def deduplicated(stream: DataFrame, ids: list[str], ts: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def delayed_label_join(preds: DataFrame, labels: DataFrame, key: str, pred_ts: str, label_ts: str, wait: str, how: str = "inner") -> DataFrame:
    """Predictions matched with labels that arrive within ``wait``; ``leftOuter`` also emits predictions that never got one."""
    p = preds.withWatermark(pred_ts, "1 hour").alias("p")
    l = labels.withColumnRenamed(key, "_k").withWatermark(label_ts, "1 hour").alias("l")
    cond = (F.col(key) == F.col("_k")) & F.expr(f"{label_ts} >= {pred_ts} AND {label_ts} <= {pred_ts} + INTERVAL {wait}")
    return p.join(l, cond, how).drop("_k")


class ProgressLog(StreamingQueryListener):
    """Appends every progress record of the session's streams to a folder, one small file a micro-batch, however long a run is.

    A retried micro-batch replaces its file. Leaving the block waits until the streams that started in it have reported their end.
    """

    schema = "query string, batch long, input_rows long, trigger_ms long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.running: set[str] = set()
        self.changed = threading.Condition()
        self.failed: Exception | None = None

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"query": str(p.id), "batch": p.batchId, "input_rows": p.numInputRows, "trigger_ms": int(dict(p.durationMs).get("triggerExecution", 0))}
        try:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p.id}-{p.batchId}.json")
            out = path.getFileSystem(conf).create(path, True)
            out.write(bytearray(json.dumps(row).encode()))
            out.close()
        except Exception as e:  # raised when the block is left: an error here would only reach the log
            self.failed = e

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.running.discard(str(event.runId))
            self.changed.notify_all()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        with self.changed:
            ended = self.changed.wait_for(lambda: not self.running, timeout=60)
        self.spark.streams.removeListener(self)
        if self.failed is not None:
            raise self.failed
        if not ended:
            raise TimeoutError("streams have not reported their end")

    def records(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(self.folder)
