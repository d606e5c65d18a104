"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .frames import group_key, let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WORDS = 5
#: Candidate cut-offs by statistic, from strict to lenient; a document fails a rule when its statistic is beyond the cut-off.
GRID = {
    "symbols_per_word": ("above", [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2]),
    "dup_line_share": ("above", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5]),
    "repeat_share": ("above", [0.01, 0.02, 0.05, 0.1, 0.15]),
    "short_words": ("below", [5.0, 4.5, 4.0, 3.5, 3.0, 2.5]),
    "long_words": ("above", [7.0, 8.0, 9.0, 10.0, 12.0, 15.0]),
}
#: Good documents that one rule may reject at most, and the chance that any of the chosen cut-offs does worse.
RISK, ERROR = 0.01, 0.05


def repeated_words(words: Column) -> Column:
    """Words in five-word windows that occur at least twice among ``words`` (array), each word counted once.

    Windows are compared by 64-bit hashes. Only a text in which some hash repeats is sorted by (hash, place).
    """
    n = F.size(words)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.zip_with(h, F.sequence(F.lit(0), F.size(h) - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda x, j: x["h"] == F.get(p, j)["h"]
            hit = F.filter(p, lambda x, j: F.coalesce(same(x, j + 1), F.lit(False)) | F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda x, j: F.least(F.lit(WORDS), F.coalesce(F.get(at, j + 1) - x, F.lit(WORDS))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, lambda p: let(places(p), total))).otherwise(F.lit(0).cast("long"))

    return F.when(n > WORDS, let(words, lambda w: let(hashes(w), covered))).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """id, ``carry`` columns, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``.

    Words are separated by space and the control characters 9 to 13; lines by line feed, only lines with a word count.
    Null texts have no words. Columns only.
    """
    carry = carry or {}
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(docs[id_col].alias("id"), *[c.alias(f"c_{n}") for n, c in carry.items()], text.alias("t"))
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = base.select("id", *[f"c_{n}" for n in carry], words.alias("w"), lines.alias("l"),
                      F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                      (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    return one.select(F.col("id").alias(id_col), *[F.col(f"c_{n}").alias(n) for n in carry], F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
                      (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("w")).alias("n_repeat_words"),
                      F.size("l").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The statistics of ``GRID`` from the counts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean = F.col("word_chars") / n
    return {"symbols_per_word": F.col("n_symbols") / n, "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n, "short_words": mean, "long_words": mean}


def _lgamma(x: Column) -> Column:
    """log gamma for x >= 1 by Stirling's series at x + 8."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    top = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series
    steps = sum((F.log(x + float(k)) for k in range(1, 8)), F.log(x))
    return top - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), k < n p: the term at k times the sum of its ratios downwards."""
    k, n = k.cast("double"), n.cast("double")
    log_term = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    step = lambda a, i: F.struct((a["t"] * (i * (1 - p)) / ((n - i + 1) * p)).alias("t"), (a["s"] + a["t"] * (i * (1 - p)) / ((n - i + 1) * p)).alias("s"))
    down = F.when(k > 0, F.reverse(F.sequence(F.lit(1), k.cast("int")))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(down, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: step(a, i.cast("double")), lambda a: a["s"])
    return F.exp(log_term) * total


def thresholds(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(``stratum``, ``rule``, ``cutoff``): for each stratum and rule the strictest cut-off that is proven.

    ``labelled``: good documents of the holdout with ``_s`` (stratum key) and the counts. Of the n good documents of a stratum a
    cut-off rejects k. It is proven when k or fewer of n would be seen with a chance of at most error / (number of tests) if it
    rejected more than ``risk`` of all good ones (exact binomial). The tests are all strata x rules x cut-offs, so with a
    chance of 1 - ``error`` all cut-offs that are used keep the limit. Rules without a proven cut-off reject nothing.
    """
    m = measures()
    beyond = {r: [(m[r] > c if side == "above" else m[r] < c) for c in cuts] for r, (side, cuts) in GRID.items()}
    sums = [F.sum(x.cast("int")).alias(f"{r}_{i}") for r, xs in beyond.items() for i, x in enumerate(xs)]
    counts = labelled.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{i}").alias("k"))
                     for r, (_, cuts) in GRID.items() for i, c in enumerate(cuts)])
    tests = counts.select("_s", "n", F.explode(rows).alias("x")).select("_s", "n", "x.*")
    tests = tests.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    proven = F.when(F.col("k") < F.lit(risk) * F.col("n"), binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(error) / F.col("m")).otherwise(F.lit(False))
    return tests.filter(proven).groupBy("_s", "rule").agg(F.min_by("cutoff", "i").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          good: int = 1, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per document: id, ``stratum``, the counts of ``statistics``, ``base_failed``, ``failed`` (array of rules) and ``kept``.

    Cut-offs are chosen per stratum on the labelled good documents that pass the base rules; the grid is fixed, so the labels
    serve as a holdout. Documents whose stratum has no proven cut-off, labels or not, are judged by the base rules alone. Null
    strata are a stratum. Null texts fail the base rules. Rows with equal ids are judged each; labels that repeat an id or contradict
    each other count as good only if all say so. Empty labels leave the base rules, an empty table gives an empty one.
    """
    stats = cut(statistics(docs, id_col, text_col, {"stratum": docs[stratum_col], "_s": group_key(docs[stratum_col])}))
    verdict = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.coalesce(F.col(label_col) == good, F.lit(False)).cast("int")).alias("_g")).filter("_g = 1")
    clean = stats.filter(~base_failed()).join(verdict, stats[id_col] == F.col("_id"), "left_semi")
    rules = list(GRID)
    chosen = thresholds(clean, risk, error).groupBy("_s").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in rules])
    both = stats.join(chosen, "_s", "left")
    m = measures()
    fails = F.array(*[F.when(m[r] > F.col(f"_cut_{r}") if GRID[r][0] == "above" else m[r] < F.col(f"_cut_{r}"), F.lit(r)) for r in rules])
    out = both.withColumn("base_failed", base_failed()).withColumn("failed", F.array_compact(fails))
    return out.select(id_col, "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "failed",
                      (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
