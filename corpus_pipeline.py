"""From raw documents to packed training sequences: language, near-copies, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm import language, minhash, mixing, packing, secrets
from fleetspark.llm.frames import row_hash, text_mark
from fleetspark.llm.queries import tokenizer_path
from fleetspark.scratch import cut, new_path

#: A document goes if no language reaches this mean probability (or it has no letters); sources are repeated so many times at most.
LEAST_SCORE, MAX_REPEATS = 0.35, 1.25
#: Rows that a batch between Spark and Python holds: texts can be long, so fewer than Spark's ten thousand.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the network learns from the labels of the documents that are not held out.

    Where there are no such labels there is no network, and every document that has a letter stays.
    """
    small_batches(spark)
    network = language.train(docs)
    if network is None:
        return docs.filter(language.has_letters(docs["text"]))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs["text"])
    out = language.identify(rows, network, carry=["doc"])
    return out.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    small_batches(spark)
    return minhash.drop_near_duplicates(docs)


def cover_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; ``n_chars`` follows the text."""
    small_batches(spark)
    out = secrets.redacted(docs, secrets.scan(docs, new_path(spark, "ledger")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of smaller sources again until the tempered weights are met.

    Uses are counted for rows that agree in all columns. Each row is used as often as the count divides; what is left over goes
    to one of them.
    """
    mark = F.struct(text_mark(docs["text"]), row_hash(docs))
    uses = mixing.mix(docs, max_repeats=MAX_REPEATS, carry={"_mark": mark}).groupBy(F.col("doc_id").alias("_id"), "_mark")
    uses = uses.agg(F.count_if(F.col("block") == 1).alias("_rows"), F.count(F.lit(1)).alias("_uses"))
    uses = uses.select("_id", "_mark", F.expr("_uses div _rows - 1").cast("int").alias("_more"), F.expr("_uses % _rows").cast("int").alias("_over"))
    uses = cut(uses.filter("_more > 0 OR _over > 0"))
    same, columns = docs["doc_id"].eqNullSafe(F.col("_id")) & (mark == F.col("_mark")), [docs[f"`{c}`"] for c in docs.columns]
    times = F.sequence(F.lit(0), F.coalesce("_more", F.lit(0)))
    out = docs.join(uses, same, "left").withColumn("_use", F.explode(times)).select(*columns)
    over = uses.filter("_over > 0")
    count = over.count()
    if count:
        over = F.broadcast(over) if count <= minhash.FEW_IDS else over
        one = docs.join(over, same).groupBy("_id", "_mark").agg(F.any_value(F.struct(*columns)).alias("_row"), F.max("_over").alias("_over"))
        out = out.unionByName(one.withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("_over")))).select("_row.*"))
    return out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    small_batches(spark)
    out = packing.pack(docs, tokenizer_path(), 2048, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", keep_languages), ("near-duplicates", drop_near_copies), ("secrets", cover_secrets), ("mixture", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
