"""Secret scans with an incremental blob ledger."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches

# Kind, version, pattern, group that is measured, its least length. Kinds are listed in the order of the result.
RULES = [
    ("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    ("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]
BASE = ("assign", "access", "hex")
_SPANS = "array<struct<start:int,rule:int,end:int>>"


def rule_id(rule: tuple) -> str:
    return f"{rule[0]}@{rule[1]}"


def find(text: str, rules: list[tuple]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost matches that do not overlap within a kind; too short ones are dropped."""
    out = []
    for kind, _, pattern, group, least in rules:
        for m in re.compile(pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return out


def _ledger(spark, path: str) -> DataFrame:
    schema = "blob string, rule string, spans array<struct<start:int,end:int>>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str, rules: list[tuple] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per version: path, ``blob`` (sha-256 of the text) and ``spans`` (start, rule, end; by start, then rule; code points).

    The ledger, a Parquet folder, holds the findings of each (blob, rule version) that was ever scanned, empty ones too. Each blob
    with missing pairs is scanned once, however many paths and versions hold it, for the missing rules only; findings
    are appended and joined back to all paths by blob. A later call scans new blobs for all rules and known ones for new
    rule versions.

    Null texts count as empty. Null or equal paths are separate rows. A row per (blob, rule) is taken once from the ledger, so an
    append that was repeated after a failure does no harm. An empty table gives an empty one.
    """
    spark = versions.sparkSession
    text = F.coalesce(versions[text_col], F.lit(""))
    rows = versions.select(versions[path_col].alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"))
    blobs = rows.groupBy("blob").agg(F.min("path").alias("path"))
    names = [rule_id(r) for r in rules]
    known = _ledger(spark, ledger).filter(F.col("rule").isin(names))
    seen = known.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    due = F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>")))
    pending = blobs.join(seen, "blob", "left").select("path", F.col("blob").alias("_blob"), due.alias("due")).filter(F.size("due") > 0)
    texts = versions.select(versions[path_col].alias("_path"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("blob"))
    work = texts.join(pending, F.col("_path").eqNullSafe(F.col("path")) & (F.col("blob") == F.col("_blob"))).select("blob", "due", "text")
    by_name = {rule_id(r): r for r in rules}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("secrets")
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            blob, rule, spans = [], [], []
            for i in range(batch.num_rows):
                b, due, t = (batch.column(k)[i].as_py() for k in range(3))
                for name in due:
                    blob.append(b), rule.append(name)
                    spans.append([{"start": s, "end": e} for _, s, e in find(t, [by_name[name]])])
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.string()), pa.array(rule, pa.string()), pa.array(spans, kind)], names=["blob", "rule", "spans"])

    work.mapInArrow(search, "blob string, rule string, spans array<struct<start:int,end:int>>").write.mode("append").parquet(ledger)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("rule")).cast("int") - 1
    found = _ledger(spark, ledger).filter(F.col("rule").isin(names) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
    found = found.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place.alias("rule"), s["end"].alias("end"))).alias("spans"))
    found = found.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    out = rows.join(found, "blob", "left")
    return out.select(F.col("path").alias(path_col), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def redacted(docs: DataFrame, scanned: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all rows and columns kept, with every span of ``scanned`` replaced by ``[secret]``.

    Overlapping spans are replaced as one. Only texts with findings go through Python.
    """
    found = scanned.filter(F.size("spans") > 0).select(F.col(path_col).alias("_path"), F.col("blob").alias("_blob"), F.col("spans").alias("_spans")).distinct()
    text = docs[f"`{text_col}`"]
    both = docs.join(found, docs[f"`{path_col}`"].eqNullSafe(F.col("_path")) & (F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256) == F.col("_blob")), "left")

    @F.pandas_udf("string")
    def cover(texts, spans):
        def one(t, ss):
            if t is None or ss is None:
                return None
            out, at = [], 0
            for s, e in sorted((int(x["start"]), int(x["end"])) for x in ss):
                if e > at:
                    out.append(t[at:max(s, at)] + ("[secret]" if s >= at else ""))
                    at = e
            return "".join(out) + t[at:]
        import pandas as pd
        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    clean = F.coalesce(cover(F.when(F.col("_spans").isNotNull(), text), F.col("_spans")), text)
    return both.select(*[clean.alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])
