"""Document fingerprints by spot signatures: chains of content words behind common words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .frames import group_key, let

# Common words of four languages that chains start at.
ANCHORS = """
the of and to in a is was for it that with as on by are be this at from or an have had not but
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an
de la le et les des en un du une que est pour qui dans par sur au plus pas ce il elle
de la que el en y a los se del las un por con no una su para es al lo como mi
""".split()
#: Content words in a chain, and steps between them.
CHAIN, GAP = 3, 1
#: Bits of a signature.
BITS = 48
_MARK = "\x01"


def normalised(text: Column) -> Column:
    """Lower case, letters and digits only, words apart by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, gap: int = GAP) -> Column:
    """The ascending set of signatures of a text.

    Anchors are glued to the content word before them, so the pieces between spaces are the content words in order, each with the
    anchors that follow it. Every anchor forms a signature with the next ``chain`` content words, ``gap`` apart. A text with
    words but without a full chain has one signature of all its words; a text without words has none.
    """
    words = sorted(set(anchors))
    reach = 1 + (chain - 1) * gap

    def word(p: Column, i: Column) -> Column:
        return F.substring_index(F.get(p, i), _MARK, 1)

    def spots(p: Column) -> Column:
        def at(piece: Column, k: Column) -> Column:
            tail = [word(p, k + 1 + j * gap) for j in range(chain)]
            many = F.transform(F.slice(F.split(piece, _MARK), F.lit(2), F.size(p)), lambda a: F.xxhash64(a, *tail))
            return F.when((F.instr(piece, _MARK) > 0) & (k + reach < F.size(p)), many)
        return F.flatten(F.filter(F.transform(p, at), lambda x: x.isNotNull()))

    def whole(s: Column) -> Column:
        glued = F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.when(w.isin(words), F.lit(_MARK)).otherwise(F.lit(" ")), w)), "")
        found = let(F.split(glued, " "), spots)
        return F.when(s == "", F.array().cast("array<bigint>")).otherwise(
            let(found, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(F.transform(x, lambda h: F.shiftrightunsigned(h, 64 - BITS)))))
                .otherwise(F.array(F.shiftrightunsigned(F.xxhash64(s), 64 - BITS)))))

    return let(normalised(text), whole)


def fingerprint(sigs: Column) -> Column:
    """A signature set as text: fixed-width hexadecimal numbers, ascending, one after the other."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets, 1 for two empty ones. Where the sizes alone rule out ``least``, the sets are not compared."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    met = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < F.lit(least) * large), F.lit(0.0)).otherwise(
        let(met, lambda m: m / (F.size(a) + F.size(b) - m)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id``, ``text``, ``head``, ``next_sigs``) by ascending id, after the last the first: each document with the signatures of the
    next one and as many of its first code points as half the document's own.

    The order is found on ids, text hashes and lengths only: sorted by range, stored, then each range hands on its last row. Texts
    are moved by id once, for both roles; what then goes to the document before is cut to what it needs. Null ids come
    first; equal ids are ordered by hash; rows equal in id and text are one document in this order.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    base = base.select(group_key(F.col("id")).alias("k"), F.xxhash64("text").alias("h"), "id", "text")
    keys = base.select("id", "h", "k", F.length("text").alias("n")).repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h")
    keys = cut(keys.withColumn("part", F.spark_partition_id()))
    repeated = keys.groupBy("k", "h").count().filter("count > 1").limit(1).count()
    once = keys.dropDuplicates(["k", "h"]) if repeated else keys
    row = F.struct("id", "h", "k", "n")
    lasts = once.groupBy("part").agg(F.max(row).alias("last"))
    order = Window.orderBy("part")
    tails = lasts.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("tail"))
    before = once.withColumn("prev", F.lag(row).over(Window.partitionBy("part").orderBy("id", "h"))).join(tails, "part")
    before = before.select("k", "h", F.coalesce("prev", "tail").alias("prev")).select("k", "h", F.col("prev.k").alias("pk"), F.col("prev.h").alias("ph"), F.col("prev.n").alias("pn"))
    nexts = base.join(before, ["k", "h"])
    if repeated:
        nexts = nexts.dropDuplicates(["k", "h"])
    half = F.floor(F.col("pn") / F.lit(2)).cast("int")
    nexts = nexts.select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.substring(F.col("text"), F.lit(1), half).alias("head"), signatures(F.col("text")).alias("next_sigs"))
    # the id comes back from the key, so both roles move the same columns and share one exchange
    id_ = F.when(F.col("k") != "n", F.substring("k", 2, 2**31 - 1).cast(docs.schema[id_col].dataType))
    return base.join(nexts, ["k", "h"]).select(id_.alias("id"), "text", "head", "next_sigs")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited`` (text), ``sigs`` and ``edited_sigs`` (sets), ``near_edited``, ``near_next``.

    The edited text is the document's with the last half of its code points replaced by the first as many of the next document (all
    of it if it is shorter). Null texts count as empty. Equal texts have equal sets. Columns only.
    """
    both = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / F.lit(2)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.col("head"))
    out = both.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), signatures(F.col("text")).alias("sigs"), signatures(edited).alias("edited_sigs"), "next_sigs")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited", "sigs", "edited_sigs", likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                      likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``a``, ``b``, ``likeness``): pairs of different signature sets with at least this likeness, each set named by its smallest id.

    Sets are partitioned by length so that partners lie in the same partition or the next; a set sends its rarest signatures, of
    which a partner of this likeness must share one, to its own and, with the upper part of the lengths, to the next partition. Pairs
    whose lengths rule the likeness out are dropped before the sets are compared. Empty sets have no partners.
    """
    sets = docs.select(docs[id_col].alias("id"), signatures(docs[text_col]).alias("sigs")).filter(F.size("sigs") > 0)
    sets = cut(sets.groupBy("sigs").agg(F.min("id").alias("id")))
    rows = sets.select("id", F.size("sigs").alias("n"), F.posexplode("sigs").alias("_", "sig"))
    counted = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "sig")
    rare = rows.join(counted.filter("df > 1"), "sig").withColumn("r", F.row_number().over(order))
    single = rows.join(counted.filter("df = 1"), "sig").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    keep = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    rare = rare.join(single, "id", "left").filter(F.col("r") + F.coalesce("alone", F.lit(0)) <= keep)
    part = F.floor(F.log("n") / F.lit(-math.log(least))).cast("int")
    sent = rare.select("id", "n", "sig", part.alias("part"))
    wide = sent.select(F.col("id").alias("b"), F.col("n").alias("m"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("part").alias("own"))
    met = sent.withColumnRenamed("id", "a").join(wide, ["part", "sig"])
    met = met.filter(((F.col("own") > F.col("part")) | (F.col("a") < F.col("b"))) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = [sets.select(F.col("id").alias(s), F.col("sigs").alias(f"s{s}")) for s in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).filter(F.col("likeness") >= least)
