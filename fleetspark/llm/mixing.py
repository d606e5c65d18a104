"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .frames import draw, group_key, rank_in_groups

#: Halvings that one pass over the sources settles, and halvings in all.
DEPTH, HALVINGS = 6, 54


def n_words(text: Column) -> Column:
    """Words between white space (space and the control characters 9 to 13); null counts as none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def _moments(sources: DataFrame, exponents: list[float], low: float, high: float) -> list[tuple[float, float]]:
    """For each exponent the sums of q and of q log q's factor, q = (tokens / largest)^exponent; one row to the driver."""
    lp = F.log(F.col("tokens") / F.lit(high))
    cols = [x for i, t in enumerate(exponents) for x in (F.sum(F.exp(lp * t)).alias(f"z{i}"), F.sum(F.exp(lp * t) * lp).alias(f"a{i}"))]
    row = sources.agg(*cols).first()
    return [(row[f"z{i}"], row[f"a{i}"]) for i in range(len(exponents))]


def temperature(sources: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None,
                budget: float | None = None) -> tuple[float, float]:
    """The exponent in [0, 1] and the token budget for ``sources`` (column ``tokens``, positive; one row per source).

    Weights are tokens^exponent, normalised. The exponent is the smallest at which no source is repeated more than
    ``max_repeats`` times within the budget, or the one at which the weights' entropy (nats) is ``target_entropy``; both
    decrease with it, so it is found by halving the interval. Each pass computes what all exponents that the next six
    halvings can visit need, and brings back one row. Without ``budget`` the largest source is used exactly once, so every
    other one is used at least once and nothing is lost. A budget beyond ``max_repeats`` times all tokens is cut to that.
    """
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    row = sources.agg(F.count(F.lit(1)), F.min("tokens"), F.max("tokens"), F.sum("tokens")).first()
    count, low, high, total = row[0], row[1], row[2], row[3]
    if not count:
        return 1.0, 0.0
    low, high, total = float(low), float(high), float(total)
    if budget is not None and max_repeats is not None:
        budget = min(float(budget), max_repeats * total)

    def too_flat(t: float, z: float, a: float) -> bool:
        """The exponent must grow."""
        if target_entropy is not None:
            return math.log(z) - t * a / z > target_entropy
        spent = budget if budget is not None else high * z
        return spent * (low / high) ** t / z / low > max_repeats

    left, right, done = 0.0, 1.0, 0
    (z, a), = _moments(sources, [0.0], low, high)
    if not too_flat(0.0, z, a):
        right, done = 0.0, HALVINGS
    while done < HALVINGS:
        inner = [left + (right - left) * k / 2**DEPTH for k in range(1, 2**DEPTH)]
        found = dict(zip(inner, _moments(sources, inner, low, high)))
        lo, hi = 0, 2**DEPTH
        while hi - lo > 1:
            mid = (lo + hi) // 2
            t = inner[mid - 1]
            lo, hi = (mid, hi) if too_flat(t, *found[t]) else (lo, mid)
        left, right = left + (right - left) * lo / 2**DEPTH, left + (right - left) * hi / 2**DEPTH
        done += DEPTH
    (z, _), = _moments(sources, [right], low, high)
    return right, budget if budget is not None else high * z


def mix(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None,
        seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per use of a document: id, ``source``, ``n_tokens``, ``block`` (from 1), ``slot`` (place in the block, from 0),
    ``blocks`` (uses of the source, a fraction), ``weight`` of the source.

    Tokens: words of the text plus one end mark, so no source is empty. A source with budget b and n tokens gives floor(b / n)
    whole blocks, each a seeded permutation of all its documents, and from one more permutation the leading documents whose
    tokens fit the rest. See ``temperature`` for the weights.

    Null sources are a source of their own; null or empty texts weigh one token; null and equal ids take part, rows equal in
    id, source and tokens are interchangeable. ``carry`` adds columns of the document by name; they break these ties. An empty
    table gives an empty one. Columns only, no Python on the executors.
    """
    carry = carry or {}
    rows = cut(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), group_key(docs[source_col]).alias("_s"),
                           (n_words(docs[text_col]) + 1).alias("n_tokens"), *[c.alias(n) for n, c in carry.items()]))
    sources = cut(rows.groupBy("_s").agg(F.sum("n_tokens").alias("tokens")))
    exponent, spent = temperature(sources, max_repeats, target_entropy, budget)
    raw = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    norm = sources.agg(F.sum(raw)).first()[0] or 1.0
    shares = sources.withColumn("weight", raw / F.lit(norm)).withColumn("_b", F.round(F.col("weight") * F.lit(spent)).cast("long"))
    uses = rows.join(shares, "_s").withColumn("_last", F.ceil(F.col("_b") / F.col("tokens")).cast("int"))
    uses = uses.withColumn("block", F.explode(F.expr("CASE WHEN _last > 0 THEN sequence(1, _last) ELSE array() END")))
    uses = uses.withColumn("_g", F.concat_ws("|", F.col("block").cast("string"), "_s"))
    uses = uses.withColumn("_u", draw(seed, F.col("block"), F.col("id")))
    ranked = rank_in_groups(uses, "_g", "_u", ["id", "n_tokens", *carry], weight="n_tokens")
    fits = (F.col("block") - 1) * F.col("tokens") + F.col("_upto") <= F.col("_b")
    return ranked.filter(fits).select(F.col("id").alias(id_col), "source", "n_tokens", F.col("block").cast("long").alias("block"),
                                      F.col("_rank").alias("slot"), (F.col("_b") / F.col("tokens")).alias("blocks"), "weight", *carry)
