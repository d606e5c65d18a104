"""Telemetry and run views over the given tables, once for Spark and once as SQL text.

``telemetry``  sensor rows per tool            (events)
``faults``     fault events per tool           (events)
``runs``       one process run per row         (orders)
``run_rows``   sensor rows inside a run        (lineitem)
``scores``     binary label with a score       (labels, documents)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import NUDGE, PLACES, twin

from ..functions.scalars import draw

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
FAULTS = [0, 1, 2]
REGIMES = ["1A", "1B", "4A", "4B"]
SEQ = ["q1", "q2", "q3", "q4"]  # unique order of rows that share a time inside a run
HOUR = 3600.0


def micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({c} as timestamp_ntz))")


def days(c: str):
    return F.expr(f"timestampdiff(DAY, {EPOCH}, cast({c} as timestamp_ntz))")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("tool"), F.col("event_id").alias("id"), (micros("ts") / 1e6).alias("t"),
        F.col("event_type").alias("recipe"), (k % 5).alias("recipe_step"), F.floor(k / 10).cast("int").alias("runnum"),
        F.col("value").alias("s1"), F.when(k % 11 != 0, k.cast("double")).alias("s2"))


def faults(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("tool"), F.col("event_id").alias("id"), (micros("ts") / 1e6).alias("t"),
        (k % 3).alias("fault"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    key, d = F.col("o_orderkey"), days("o_orderdate")
    wafer = F.floor(key / 2)
    grp = F.when(wafer % 3 == 0, 1).otherwise(4)
    stage = F.when(key % 2 == 0, "A").otherwise("B")
    t = (d * 3600 + (key * 7919) % 3600).cast("double")
    dur = (120 + F.col("o_custkey") % 300).cast("double")
    out = table(spark, sf, "orders").select(
        key.alias("run_id"), wafer.alias("wafer"), stage.alias("stage"), grp.alias("grp"),
        F.concat(grp.cast("string"), stage).alias("regime"), t.alias("t_start"), dur.alias("duration"),
        (t + dur).alias("t_end"), (F.col("o_totalprice") / 1000).alias("y"),
        ((d * 3) % 500 + F.col("o_custkey") % 3).cast("double").alias("usage"),
        ((d * 7) % 900).cast("double").alias("pad"), (F.col("o_custkey") % 50).cast("double").alias("film"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "test").when(F.col("o_orderpriority") == "5-LOW", "val")
        .otherwise("train").alias("split"))
    return out.withColumns({"is_ref": F.col("split") == "train", "measured": draw("m", "run_id") < 0.7})


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey")
    grp = F.when(F.floor(part / 2) % 3 == 0, 1).otherwise(4)
    return table(spark, sf, "lineitem").select(
        part.alias("run_id"), (grp + F.col("l_linenumber") % 3).alias("chamber"),
        ((F.col("l_orderkey") % 600) / 2).alias("ts"), F.col("l_orderkey").alias("q1"), F.col("l_linenumber").alias("q2"),
        days("l_shipdate").alias("q3"), F.col("l_suppkey").alias("q4"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")).alias("pressure"),
        (F.col("l_extendedprice") / 1000).alias("head"), F.round(F.col("l_tax") * 100).alias("flow"),
        F.round(F.col("l_discount") * 100).alias("rot"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("dw"),
        (F.col("l_suppkey") % 100).cast("double").alias("usage"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    return table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("pos"), (F.col("toxic") + 1.0).alias("w")) \
        .join(docs, "doc_id")


SQL = {
    "telemetry": """
  SELECT user_id AS tool, event_id AS id, epoch_us(ts) / 1e6 AS t, event_type AS recipe,
         (k % 5) AS recipe_step, CAST(floor(k / 10) AS INT) AS runnum, value AS s1,
         CASE WHEN k % 11 <> 0 THEN CAST(k AS DOUBLE) END AS s2
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "faults": """
  SELECT user_id AS tool, event_id AS id, epoch_us(ts) / 1e6 AS t, k % 3 AS fault
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'error')""",
    "runs": """
  SELECT *, CAST(grp AS VARCHAR) || stage AS regime, t_start + duration AS t_end, split = 'train' AS is_ref,
         CAST('0x' || substr(md5(concat_ws('_', run_id, 'm')), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 AS measured
  FROM (SELECT o_orderkey AS run_id, o_orderkey // 2 AS wafer, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS stage,
         CASE WHEN (o_orderkey // 2) % 3 = 0 THEN 1 ELSE 4 END AS grp,
         CAST(d * 3600 + (o_orderkey * 7919) % 3600 AS DOUBLE) AS t_start,
         CAST(120 + o_custkey % 300 AS DOUBLE) AS duration, o_totalprice / 1000 AS y,
         CAST((d * 3) % 500 + o_custkey % 3 AS DOUBLE) AS usage, CAST((d * 7) % 900 AS DOUBLE) AS pad,
         CAST(o_custkey % 50 AS DOUBLE) AS film,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'test' WHEN '5-LOW' THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders))""",
    "run_rows": """
  SELECT l_partkey AS run_id, CASE WHEN (l_partkey // 2) % 3 = 0 THEN 1 ELSE 4 END + l_linenumber % 3 AS chamber,
         (l_orderkey % 600) / 2 AS ts, l_orderkey AS q1, l_linenumber AS q2,
         date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS q3, l_suppkey AS q4,
         CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE l_quantity END AS pressure, l_extendedprice / 1000 AS head,
         round(l_tax * 100) AS flow, round(l_discount * 100) AS rot, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS dw,
         CAST(l_suppkey % 100 AS DOUBLE) AS usage
  FROM lineitem""",
    "scores": """
  SELECT doc_id, quality = 1 AS pos, toxic + 1.0::DOUBLE AS w, CAST(n_chars AS DOUBLE) AS score, lang
  FROM labels JOIN documents USING (doc_id)""",
}


def sql(names: str, body: str, keys: str = "", nums: str = "", ints: str = "") -> str:
    """SQL text over the views; ``keys`` pass through, ``nums`` are rounded to 6 places (``name:3``: to 3), ``ints`` become BIGINT.

    ``body`` is a query, or further CTEs followed by a query.
    """
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split())
    body = body.strip()
    lead = "WITH " if views or body.startswith("+") else ""
    if body.startswith("+"):  # more CTEs, the last one is called res
        views = ",\n".join(v for v in (views, body[1:].strip()) if v)
        source = "res"
    else:
        source = f"({body})"
    places = {n: int(p) for n, _, p in (x.partition(":") for x in nums.split()) if p}
    if not (keys or nums or ints):
        select = "*"
    else:
        select = ", ".join([*keys.split(), *[f"round(CAST({n} AS DOUBLE) + {NUDGE}, {int(p or PLACES)}) AS {n}" for n, _, p in (x.partition(":") for x in nums.split())],
                            *[f"CAST({n} AS BIGINT) AS {n}" for n in ints.split()]])
    return twin(f"{lead}{views}\nSELECT {select} FROM {source}", places)
