"""Pitman-Yor scores: exact where seating leaves no choice, else against a plain sampler that moves one customer at a time."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import lm, queries


def tokens(text):
    return [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()), b""]


def base(docs):
    """(n_tokens, n_known, N, base score) of every (text, teaches)."""
    c = collections.Counter(t for text, teach in docs if teach for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for ts in (tokens(text) for text, _ in docs)]


class Plain:
    """Restaurants as dictionaries of lists of tables; every customer moves in each sweep; a new table seats a customer in the root."""

    def __init__(self, texts, d, d0, seed):
        self.r, self.d, self.d0, self.c = random.Random(seed), d, d0, collections.Counter()
        for text in texts:
            before = b""
            for t in tokens(text):
                self.c[before, t] += 1
                before = t
        self.words = {w for _, w in self.c}
        self.tables = {k: [] for k in self.c}
        self.of = collections.Counter()
        self.root = {w: [] for w in self.words}
        for k, n in self.c.items():
            for _ in range(n):
                self.seat(*k)

    def p0(self, w):
        c, t = sum(map(sum, self.root.values())), sum(map(len, self.root.values()))
        mine = self.root.get(w, [])
        return (sum(mine) - self.d0 * len(mine) + (1 + self.d0 * t) / (len(self.words) + 1)) / (1 + c)

    def put(self, tables, weight, d):
        weights = [*[max(n - d, 0) for n in tables], weight]
        i = self.r.choices(range(len(weights)), weights)[0]
        if i == len(tables):
            tables.append(1)
            return True
        tables[i] += 1
        return False

    def take(self, tables):
        i = self.r.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            return True
        return False

    def seat(self, u, w):
        if self.put(self.tables[u, w], (1 + self.d * self.of[u]) * self.p0(w), self.d):
            self.of[u] += 1
            t = sum(map(len, self.root.values()))
            self.put(self.root[w], (1 + self.d0 * t) / (len(self.words) + 1), self.d0)

    def sweep(self):
        for (u, w), n in self.c.items():
            for _ in range(n):
                if self.take(self.tables[u, w]):
                    self.of[u] -= 1
                    self.take(self.root[w])
                self.seat(u, w)

    def predict(self, text, out):
        before = b""
        total = collections.Counter()
        for (u, _), n in self.c.items():
            total[u] += n
        for i, w in enumerate(tokens(text)):
            mine = self.tables.get((before, w), [])
            out[i] += (sum(mine) - self.d * len(mine) + (1 + self.d * self.of[before]) * self.p0(w)) / (1 + total[before])
            before = w


def scored(frame, docs, seed=1):
    df = frame([(i, text, None, "t" if teach else "h") for i, (text, teach) in enumerate(docs)])
    return sorted(lm.score(df, F.col("source") == "t", seed=seed).collect(), key=lambda r: r["doc_id"])


def test_exact_where_every_pair_is_seen_once(frame):
    docs = [("a b c d", True), ("a x", False), ("c B a", False), (None, False), ("Zz", False)]
    rows = scored(frame, docs)
    # five pairs and words with one customer each: every dish has one table on both levels
    d = d0 = 0.95
    p0 = lambda known: (known * (1 - d0) + (1 + d0 * 5) / 6) / 6
    p = lambda seen, known, context: (seen * (1 - d) + (1 + d * context) * p0(known)) / (1 + context)
    want = [p(1, 1, 1) ** 5, p(1, 1, 1) * p(0, 0, 1) * p(0, 1, 0), p(0, 1, 1) * p(0, 1, 1) * p(0, 1, 1) * p(0, 1, 1), p(0, 1, 1), p(0, 0, 1) * p(0, 1, 0)]
    assert [r["score"] for r in rows] == pytest.approx([math.log10(x) for x in want], abs=1e-9)
    for r, (n, known, total, b) in zip(rows, base(docs)):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["base_score"] == pytest.approx(b, abs=1e-9)
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / n))


def test_scores_near_those_of_a_plain_sampler(frame):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    text = lambda: " ".join(r.choices(words, weights)[0] for _ in range(r.randrange(5, 25)))
    docs = [(text(), i < 40) for i in range(60)]
    rows = scored(frame, docs)
    ones = collections.Counter()
    for t, teach in docs:
        if teach:
            ts = tokens(t)
            ones.update(zip([b"", *ts], ts))
    at = collections.Counter(collections.Counter(w for _, w in ones).values())
    c = collections.Counter(ones.values())
    plain = Plain([t for t, teach in docs if teach], lm.discount_of(c[1], c[2]), lm.discount_of(at[1], at[2]), 5)
    sums, samples = [np.zeros(len(tokens(t))) for t, _ in docs], 40
    for s in range(10 + samples):
        plain.sweep()
        if s >= 10:
            for (t, _), out in zip(docs, sums):
                plain.predict(t, out)
    want = np.array([np.log10(x / samples).sum() for x in sums])
    got = np.array([row["score"] for row in rows])
    n = np.array([row["n_tokens"] for row in rows])
    assert np.abs((got - want) / n).max() < 0.08 and abs((got - want).sum() / n.sum()) < 0.02


def test_seating_keeps_every_customer_and_follows_the_exact_law():
    """Three customers of one dish, base p: the share of samples with each number of tables follows from the weights of all partitions."""
    d, p, n = 0.5, 0.3, 3000
    t = np.mean([lm.seat(np.full(n, 3), np.arange(n), np.full(n, p), np.zeros(n), d, s, samples=1, burn=20)[0] for s in range(3)], axis=0)
    weight = {1: 1 * (1 - d) * (2 - d) * 1.0, 2: 3 * (1 - d) * (1 + d) * p, 3: (1 + d) * (1 + 2 * d) * p**2}
    mean = sum(k * w for k, w in weight.items()) / sum(weight.values())
    assert t.mean() == pytest.approx(mean, abs=0.04)
    big = lm.seat(np.array([10**9, 2, 1, 0, 50_000]), np.array([0, 0, 1, 1, 2]), np.array([0.2, 0.1, 0.1, 0.1, 0.9]), np.zeros(3), 0.7, 1)
    assert all((x[[0, 1, 2, 4]] >= 1).all() and x[3] == 0 and (x <= [10**9, 2, 1, 0, 50_000]).all() for x in big)


def mean_tables(c, elsewhere, d, p):
    """Expected tables of one dish of c customers with its restaurant's other tables given: weights of all numbers of tables, by recursion."""
    t, w = np.arange(c + 2), np.zeros(c + 2)
    w[0] = 1
    for n in range(c):
        w = w * np.maximum(n - d * t, 0) + np.append(0, w[:-1])
        w /= w.max()
    w = np.log(w[1:c + 1] + 1e-300) + np.cumsum(np.log((1 + d * (elsewhere + np.arange(c))) * p))
    w = np.exp(w - w.max())
    return (w * np.arange(1, c + 1)).sum() / w.sum()


def test_a_sweep_moves_every_customer():
    """Dishes of 60 customers, held one by one or as tables' sizes, reach the exact mean in the default number of sweeps."""
    n, want = 2000, mean_tables(60, 40, 0.8, 0.1)
    seat = lambda s: np.mean(lm.seat(np.full(n, 60), np.arange(n), np.full(n, 0.1), np.full(n, 40.0), 0.8, s))
    single = lm.SINGLE
    got = [seat(1)]
    try:
        lm.SINGLE = 50
        got.append(seat(2))
    finally:
        lm.SINGLE = single
    assert got == pytest.approx([want] * 2, rel=0.06)


def test_first_seating_has_no_cap():
    """A dish of three million customers, where a new table is likely, starts at the expected number of tables: above two million."""
    t = lm.seat(np.array([3_000_000]), np.array([0]), np.array([1.0]), np.array([5e6]), 0.7, 1, samples=1, burn=0)[0]
    a = 1 + 0.7 * (5e6 + 1)
    assert t[0] == pytest.approx(a * math.log((a + 3e6) / (a + 1)), rel=0.01)


def test_parts_do_not_change_what_is_counted(spark, frame):
    """Several parts with hot words spread: counts and base scores are exact, scores near those of one part."""
    r = random.Random(8)
    docs = [(" ".join(r.choice(["the", "the", f"w{r.randrange(40)}"]) for _ in range(30)), i % 4 > 0) for i in range(120)]
    df = frame([(i, text, None, "t" if teach else "h") for i, (text, teach) in enumerate(docs)])
    one = scored(frame, docs)
    default = lm.PART_BYTES
    lm.PART_BYTES = 3000
    try:
        many = sorted(lm.score(df, F.col("source") == "t").collect(), key=lambda r: r["doc_id"])
        assert len(lm.hot_words(df.select(df.text.cast("binary")), 5)) > 0
    finally:
        lm.PART_BYTES = default
    for a, b, (n, known, total, low) in zip(one, many, base(docs)):
        assert (b["n_tokens"], b["n_known"], b["train_tokens"]) == (n, known, total) and b["base_score"] == pytest.approx(low, abs=1e-9)
        assert abs(a["score"] - b["score"]) / n < 0.1


def test_awkward_documents(frame, awkward, spark):
    df = frame(awkward)
    rows = lm.score(df, F.col("doc_id").isNotNull()).collect()
    assert len(rows) == len(awkward)
    want = base([(r[1], r[0] is not None) for r in awkward])
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == sorted((*w[:3], round(w[3], 6)) for w in want)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    untaught = lm.score(df, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in untaught)
    assert lm.score(df.limit(0), F.lit(True)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("postings_")]


def test_query(spark):
    """Counts and base scores by plain Python on the whole table; held-out perplexity below that of the base."""
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = sorted(queries.QUERIES["op13_pitman_yor_scores"](spark, sf).collect(), key=lambda r: r["doc_id"])
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    assert [r["held_out"] for r in rows] == held
    for r, want in zip(rows, base([(t, not h) for (_, t), h in zip(docs, held)])):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3] and r["base_score"] == pytest.approx(want[3], abs=1e-6)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
