"""Registered queries: each applies one operator with production parameters to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, new_path
from . import conversations, language, lm, minhash, mixing, oracles, packing, repeats, resample, rules, secrets, shards, spelling, spotsigs
from .frames import utf8_size

QUERIES, ORACLES = {}, {}
TOKENIZER = "word_bpe_49k.json"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


_DRAW = "('0x' || substr(md5(concat_ws('|', '{seed}', {cols})), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"
_KEY = "CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END"


@query("op3_interleaved_shards", oracles.shards(_DRAW.format(seed="shards", cols="doc_id::VARCHAR")))
def interleaved_shards(spark, sf):
    d = documents(spark, sf)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = shards.interleave(d, 8, carry={"size": utf8_size(d.text) + 1, "text_crc32": crc})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "position")


@query("op5_minhash_components", oracles.MINHASH)
def minhash_components(spark, sf):
    return minhash.near_duplicates(documents(spark, sf))


@query("op9_repeated_strings_removed", oracles.REPEATS)
def repeated_strings_removed(spark, sf):
    out = repeats.remove_repeats(documents(spark, sf), 50)
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_packed_sequences")
def packed_sequences(spark, sf):
    out = packing.pack(documents(spark, sf), tokenizer_path(), 2048, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_temperature_mix", f"""
WITH d AS (
  SELECT doc_id, source, {_KEY} AS s, 1 + len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS n_tokens
  FROM documents),
t AS (SELECT s, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY s),
lim AS (SELECT max(tokens) AS hi, CASE WHEN max(tokens) <= 2.0 * min(tokens) THEN 0.0 ELSE 1 - ln(2.0) / ln(max(tokens) / min(tokens)) END AS e FROM t),
w AS (SELECT s, tokens, pow(tokens / hi, e) / sum(pow(tokens / hi, e)) OVER () AS weight, hi * sum(pow(tokens / hi, e)) OVER () AS budget FROM t, lim),
b AS (SELECT *, round(weight * budget)::BIGINT AS b FROM w),
u AS (SELECT d.*, b.tokens, b.weight, b.b, unnest(range(1, ceil(b.b / b.tokens)::BIGINT + 1)) AS block FROM d JOIN b USING (s)),
x AS (SELECT *, {_DRAW.format(seed='mix', cols='block::VARCHAR, doc_id::VARCHAR')} AS r FROM u),
o AS (SELECT *, row_number() OVER p - 1 AS slot, sum(n_tokens) OVER (p ROWS UNBOUNDED PRECEDING) AS upto FROM x WINDOW p AS (PARTITION BY s, block ORDER BY r, doc_id))
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, block, slot, round(b / tokens, 6) AS blocks, round(weight, 6) AS weight FROM o
WHERE (block - 1) * tokens + upto <= b""")
def temperature_mix(spark, sf):
    out = mixing.mix(documents(spark, sf), max_repeats=2.0)
    return out.withColumns({"blocks": F.round("blocks", 6), "weight": F.round("weight", 6)})


@query("op1_importance_resample")
def importance_resample(spark, sf):
    d = documents(spark, sf)
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 AND toxic = 0")
    return resample.importance_resample(d, good).select("doc_id", "log_weight", "gumbel_key", "selected")


@query("op2_language")
def language_id(spark, sf):
    d = documents(spark, sf)
    out = language.identify(d, language.train(d), carry=["doc_id"])
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op4_spot_signatures")
def spot_signatures(spark, sf):
    out = spotsigs.compare_edited(documents(spark, sf))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
                      spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op7_risk_controlled_rules", oracles.quality())
def risk_controlled_rules(spark, sf):
    out = rules.judge(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


@query("op8_blob_ledger_secrets", oracles.secrets())
def blob_ledger_secrets(spark, sf):
    out = secrets.scan(documents(spark, sf), new_path(spark, "ledger"))
    kinds = F.array(*[F.lit(r[0]) for r in secrets.RULES])
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(secrets.BASE)], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
                      text(F.col("spans")).alias("spans"))


@query("op12_dawg_conversation_repair", oracles.conversations())
def dawg_conversation_repair(spark, sf):
    turns = conversations.damage(spark.read.parquet(f"{sf}/conversations.parquet"), conversations.turn_key())
    return conversations.digests(turns, cut(conversations.repair(turns))).drop("signature")


@query("op11_letter_count_variants", oracles.SPELLING)
def letter_count_variants(spark, sf):
    return spelling.variants(documents(spark, sf))


@query("op13_pitman_yor_scores")
def pitman_yor_scores(spark, sf):
    d = documents(spark, sf)
    out = lm.score(d, F.crc32(F.coalesce(d.doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
