"""Spelling variants: words one edit apart, found on a trie of letter-group counts by a search with a budget of one each way."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from . import caches

#: Letters that count together; the trie's levels follow this order. All other letters are the last group.
GROUPS = ("e", "t", "a", "i", "o", "n", "s", "r", "h", "l", "d", "cu", "mg", "fpw", "bvky")
LEVELS = len(GROUPS) + 1
#: Words of one sub-trie, entries of a task's word counts, candidates filtered at once, letters verified at once, queries searched at once.
SUB_TRIE, COUNTED, TOGETHER, BYTES, QUERIES = 20_000, 200_000, 400_000, 1 << 22, 2_000
#: Counts from here on share a key of a sub-trie; inside a sub-trie they stay apart.
_DIGIT = 16

_GROUP_OF = np.full(256, LEVELS - 1, np.int64)
for _i, _letters in enumerate(GROUPS):
    _GROUP_OF[[ord(c) for c in _letters]] = _i
#: One byte a code point (Latin-1): A-Z to lower case, letters kept, all else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case, as Latin-1."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def edited_counts(doc_id: str, text: str, modulus: int = 97) -> Iterator[tuple[bytes, int]]:
    """(run after its edit, occurrences) of one document: where ``modulus`` divides the crc32 of ``id:run``, one letter goes."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(runs(text)).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, n


def vocabulary(docs: DataFrame, least_letters: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with so many letters and occurrences. Tasks add up their own rows first, in bounded tables."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("spelling")
        total: dict[bytes, int] = {}

        def emit():
            words, n = list(total), list(total.values())
            for s in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words[s:s + 50_000]]), pa.array(n[s:s + 50_000], pa.int64())], names=["word", "n"])
            total.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    for word, n in edited_counts(doc, text):
                        if len(word) >= least_letters:
                            total[word] = total.get(word, 0) + n
                    if len(total) > COUNTED:
                        yield from emit()
        yield from emit()

    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")), docs[text_col]).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters one after the other, where each word starts (one more entry at the end), and the letter-group counts of each word."""
    raw = [w.encode("latin-1") for w in words]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in raw], dtype=np.int64)])
    owner = np.repeat(np.arange(len(raw)), np.diff(starts))
    vectors = np.bincount(owner * LEVELS + _GROUP_OF[flat], minlength=len(raw) * LEVELS).reshape(-1, LEVELS)
    return flat, starts, vectors


def keys(length: np.ndarray, vectors: np.ndarray, depth: int) -> np.ndarray:
    """The sub-trie of a word: its length and its first ``depth`` group counts."""
    key = length.astype(np.int64)
    for g in range(depth):
        key = key * _DIGIT + np.minimum(vectors[:, g], _DIGIT - 1)
    return key


def reachable(length: np.ndarray, vectors: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key) of every sub-trie that a word reaches with a surplus and a deficit of at most one each."""
    at, out = np.arange(len(length)), []
    for longer in (-1, 0, 1):
        spends = [[(g, longer)] for g in range(depth)] if longer else [[(a, 1), (b, -1)] for a in range(-1, depth) for b in range(-1, depth) if a != b]
        for spend in [[], *spends]:
            v, ok = vectors[:, :depth].copy(), np.ones(len(length), bool)
            for g, d in spend:
                if g >= 0:
                    v[:, g] += d
                    ok &= v[:, g] >= 0
            out.append(np.stack([at, keys(length + longer, v, depth)])[:, ok & (length + longer > 0)])
    pairs = np.unique(np.concatenate(out, 1), axis=1)
    return pairs[0], pairs[1]


class Trie:
    """Words of one length, arranged by successive letter-group counts. Nodes are ranges of the sorted vectors."""

    def __init__(self, words: list[str], counts: list[int]):
        flat, starts, vectors = letters(words)
        order = np.lexsort(vectors.T[::-1])
        self.length = int(starts[1] - starts[0])
        self.text = flat.reshape(-1, self.length)[order]
        self.count = np.array(counts, np.int64)[order]
        self.words = [words[i] for i in order]
        # place of a word among equal counts: the smallest in code-point order first
        self.place = np.empty(len(words), np.int64)
        self.place[np.argsort(np.array(self.words, object), kind="stable")] = np.arange(len(words))
        vectors, node, self.levels = vectors[order], np.zeros(len(words), np.int64), []
        for d in range(LEVELS):
            edge = node << 32 | vectors[:, d]
            edges, first = np.unique(edge, return_index=True)
            self.levels.append(edges)
            node = np.searchsorted(edges, edge)
        self.first = np.append(first, len(words))  # the leaves' ranges of words

    def leaves(self, vectors: np.ndarray, longer: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) for queries with these counts, ``longer`` letters longer than the trie's words.

        Depth first: the stack holds blocks of (query, node, surplus left, deficit left) and the last one is carried on.
        """
        n = len(vectors)
        surplus, deficit = (1, 1) if longer == 0 else (0, 1) if longer > 0 else (1, 0)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.full(n, surplus, np.int8), np.full(n, deficit, np.int8))]
        while stack:
            depth, query, node, more, less = stack.pop()
            if depth == LEVELS:
                yield query, node
                continue
            if len(query) > 16 * QUERIES:
                half = len(query) // 2
                stack += [(depth, query[:half], node[:half], more[:half], less[:half]), (depth, query[half:], node[half:], more[half:], less[half:])]
                continue
            edges, want, parts = self.levels[depth], vectors[query, depth], []
            for step in (0, 1, -1):
                ok = np.ones(len(query), bool) if step == 0 else more > 0 if step > 0 else (less > 0) & (want > 0)
                edge = node[ok] << 32 | want[ok] + step
                child = np.minimum(np.searchsorted(edges, edge), len(edges) - 1)
                hit = edges[child] == edge
                parts.append((query[ok][hit], child[hit], more[ok][hit] - (step > 0), less[ok][hit] - (step < 0)))
            block = [np.concatenate(p) for p in zip(*parts)]
            if len(block[0]):
                stack.append((depth + 1, *block))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word of the trie) for all pairs that one inserted, deleted or replaced letter tells apart. Queries have one length."""
        flat, starts, vectors = letters(words)
        length, n, found = int(starts[1] - starts[0]), self.length, []
        text = flat.reshape(-1, length)
        short = min(length, n)
        half = short // 2
        mine, theirs = [(_hash(t[:, :half]), _hash(t[:, t.shape[1] - (short - half):])) for t in (text, self.text)]
        for query, leaf in self.leaves(vectors, length - n):
            size = self.first[leaf + 1] - self.first[leaf]
            ends = np.cumsum(size)
            at = 0
            while at < len(query):  # whole leaves, about TOGETHER candidates
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
                k = size[at:to]
                q = np.repeat(query[at:to], k)
                w = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.first[leaf[at:to]], k)
                at = to
                ok = (mine[0][q] == theirs[0][w]) | (mine[1][q] == theirs[1][w])  # one edit leaves one half as it is
                q, w = q[ok], w[ok]
                step = max(1, BYTES // (length + n))
                for s in range(0, len(q), step):
                    a, b = q[s:s + step], w[s:s + step]
                    ok = _one_edit(text[a], self.text[b])
                    found.append((a[ok], b[ok]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for c in rows.T:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if a.shape[1] < b.shape[1]:
        a, b = b, a
    n = b.shape[1]
    same = np.concatenate([a[:, :n] == b, np.zeros((len(a), 1), bool)], 1).argmin(1)  # equal letters from the left
    back = np.concatenate([(a[:, 1:] == b)[:, ::-1], np.zeros((len(a), 1), bool)], 1).argmin(1)
    return same + back >= n


def neighbours(vocab: DataFrame) -> DataFrame:
    """word, ``n_near`` and ``best`` (struct of -n and word of the near word with the largest n, ties by code point) of words with near words.

    ``vocab`` (word, n) is stored and read twice. The trie's first levels (length, then as many group counts as make about ``SUB_TRIE``
    words a sub-trie) deal the words out; a larger sub-trie is cut into several by a hash. A word is sent as a query to every sub-trie that its
    budget reaches. Tasks read the words of a sub-trie, then stream its queries, so they hold one sub-trie and one batch.
    """
    spark = vocab.sparkSession
    total = vocab.count()
    depth = min(8, max(1, math.ceil(math.log(max(total, 1) / SUB_TRIE + 1, 3))))

    def keyed(reach):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                _, starts, vectors = letters(batch.column(0).to_pylist())
                length = np.diff(starts)
                at, key = reachable(length, vectors, depth) if reach else (np.arange(len(length)), keys(length, vectors, depth))
                yield pa.RecordBatch.from_arrays([pa.array(key), *[batch.column(i).take(pa.array(at)) for i in (0, 1)]], names=["key", "word", "n"])
        return run

    schema = "key long, word string, n long"
    words = vocab.select("word", "n").mapInArrow(keyed(False), schema)
    asks = vocab.select("word", "n").mapInArrow(keyed(True), schema)
    room = F.greatest(F.lit(16), F.length("word"))
    cuts = cut(words.groupBy("key").agg(F.ceil(F.sum(room) / F.lit(16 * SUB_TRIE)).cast("int").alias("cuts")))
    words = words.join(cuts, "key").select("key", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int").alias("part"), F.lit(False).alias("ask"), F.length("word").alias("size"), "word", "n")
    asks = asks.join(cuts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("part"), F.lit(True).alias("ask"), F.length("word").alias("size"), "word", "n")
    rows = words.unionByName(asks).repartition("key", "part").sortWithinPartitions("key", "part", "ask", "size")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("spelling")
        held, trie, words, counts = None, None, [], []
        for batch in batches:
            key, part, ask, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | np.diff(ask) | (ask[1:] & (np.diff(size) != 0))) + 1
            for start, end in zip([0, *change], [*change, len(key)]):
                if start == end:
                    continue
                if held != (key[start], part[start]):
                    held, trie, words, counts = (key[start], part[start]), None, [], []
                some = batch.slice(start, end - start)
                if not ask[start]:
                    words += some.column(4).to_pylist()
                    counts += some.column(5).to_pylist()
                    continue
                if not words:
                    continue
                if trie is None:
                    trie = Trie(words, counts)
                step = max(1, min(QUERIES, BYTES // int(size[start])))
                for s in range(0, some.num_rows, step):
                    queries = some.column(4).slice(s, step).to_pylist()
                    q, w = trie.near(queries)
                    if not len(q):
                        continue
                    order = np.lexsort((trie.place[w], -trie.count[w], q))
                    q, w = q[order], w[order]
                    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                    yield pa.RecordBatch.from_arrays([pa.array([queries[i] for i in q[first]]), pa.array(np.diff(np.append(first, len(q)))), pa.array(-trie.count[w[first]]),
                                                      pa.array([trie.words[i] for i in w[first]])], names=["word", "n_near", "minus", "form"])

    found = rows.mapInArrow(search, "word string, n_near long, minus long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "form")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form, form not null): follows forms to the last by doubling.

    A form has at least twice the count of its word, so chains are no longer than the logarithm of the largest count.
    """
    step = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        step = after.select("word", "root")


def variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word (one inserted, deleted or replaced letter) of largest n, ties to the smallest in code-point order, if that n
    is ``ratio`` (2 or more) times its own. Null and empty texts have no words; a null id counts as an empty one in the edit; repeated rows
    count each time; words of any length are compared whole. An empty table gives an empty one; extra columns are ignored.
    """
    vocab = cut(vocabulary(docs, least_letters, least_count, id_col, text_col))
    found = vocab.join(neighbours(vocab), "word", "left")
    has = -F.col("best.minus") >= ratio * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n")))
    last = roots(found.filter("form IS NOT NULL"))
    out = found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
