"""Language-model scores: a hierarchical Pitman-Yor bigram model seated by Gibbs sampling, averaged over samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import cut, new_path
from . import caches

#: Tokens that a task gathers before it sends them on, bytes of text that make one part of the model.
CHUNK, PART_BYTES = 1_500_000, 20_000_000
#: Strength of both levels; samples that are averaged, sweeps before the first (one sweep between two samples).
STRENGTH, SAMPLES, BURN = 1.0, 3, 3
#: Customers of a dish that are held one by one and move one at a time; a dish with more holds its tables' sizes and moves in blocks.
SINGLE, BLOCKS = 1000, 64
#: Customers of a block above which a dish's tables are drawn from by how many come to each, not one by one.
CROWD = 10_000
#: A word that follows or starts more than this share of a part's tokens is split over all parts.
HOT = 0.25
_U = np.uint64
#: The end of a text, also the context of its first word. Words are never empty, so it is no word's hash but by chance.
END = caches.WordHashes().__missing__(b"")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: smallest unsigned type, bytes of equal weight together, compressed. Floats keep their type."""
    head, body = [len(arrays)], []
    for a in arrays:
        if a.dtype.kind != "f":
            a = a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) <= np.iinfo(t).max))
        head += [len(a), a.dtype.itemsize, a.dtype.kind == "f"]
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return np.array([len(head), *head], "<i8").tobytes() + zstandard.compress(b"".join(body), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    head, raw, at, out = np.frombuffer(blob, "<i8", n, 8)[1:].reshape(-1, 3).tolist(), zstandard.decompress(blob[8 + 8 * n:]), 0, []
    for length, width, is_float in head:
        a = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length).T
        out.append(np.ascontiguousarray(a).reshape(-1).view(f"<{'f' if is_float else 'u'}{width}"))
        at += length * width
    return out


def deltas(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=_U(0))


def mix(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (u ^ (u >> _U(31))) * _U(0x9E3779B97F4A7C15) + w * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, an end after each text; words and end of each text counted."""
    words = [(t or b"").lower().split() for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    get = caches.WORDS.__getitem__
    h = np.fromiter((x for ws in words for x in (*map(get, ws), END)), _U, int(sizes.sum()))
    return h, sizes


def chunks(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[tuple]:
    """(hashes, sizes, [other columns]) of about ``CHUNK`` tokens; column 0 is the text."""
    caches.only("words")
    parts, n = [], 0
    for whole in batches:
        for s in range(0, whole.num_rows, 256):
            batch = whole.slice(s, 256)
            parts.append((*hashed(batch.column(0).to_pylist()), *[batch.column(c) for c in columns]))
            n += len(parts[-1][0])
            if n >= CHUNK:
                yield _joined(parts)
                parts, n = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple]) -> tuple:
    h, sizes, *rest = zip(*parts)
    return np.concatenate(h), np.concatenate(sizes), *[pa.concat_arrays(c) for c in rest]


def hot_words(texts: DataFrame, parts: int) -> np.ndarray:
    """Hashes of words that hold more than ``HOT`` / ``parts`` of all tokens: at most ``parts`` / ``HOT``.

    Such a word has that share in some chunk, so chunks send only words that have it there. This only deals out the work.
    """
    share = HOT / parts

    def heavy(batches):
        for h, _ in chunks(batches):
            low = (h & _U(0xFFFF)).astype(np.int64)
            some = np.bincount(low, minlength=1 << 16) > share * len(h)
            words, n = np.unique(h[some[low]], return_counts=True)
            keep = n > share * len(h)
            words, n = np.append(words[keep], _U(0)), np.append(n[keep], len(h))  # 0: all tokens
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n)], names=["word", "n"])

    rows = cut(texts.mapInArrow(heavy, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = rows.filter("word = 0").agg(F.sum("n")).first()[0] or 0
    found = [r["word"] for r in rows.filter((F.col("word") != 0) & (F.col("n") > share * total)).collect()]
    return np.sort(np.array(found, np.int64).astype(_U))


def slots(spark: SparkSession, parts: int) -> np.ndarray:
    """Numbers that Spark's hash deals to the buckets 0, 1, 2... in turn, so that every bucket holds one part."""
    rows = spark.range(parts * 40).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(parts)).alias("b")).agg(F.min("v").alias("v")).collect()
    out = np.arange(parts) + parts * 40
    out[[r["b"] for r in rows]] = [r["v"] for r in rows]
    return out


def postings(docs: DataFrame, train: Column, numbers: np.ndarray, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, chunk, ids, blob). A part holds whole contexts (hot ones are spread by their next word); its blob of a chunk has the pairs
    of words, each with its documents of the chunk and how often. Part -1: the documents of the chunk, their tokens, whether they teach."""
    kind = docs.schema[id_col].dataType
    parts = len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (h, sizes, ids, teach) in enumerate(chunks(batches, 1, 2)):
            chunk = TaskContext.get().partitionId() << 32 | k
            teach = teach.to_numpy(zero_copy_only=False).astype(np.uint8)
            blobs, where = [pack(sizes, teach)], [-1]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            u = np.append(_U(END), h[:-1])
            key = mix(u, h)
            order = np.argsort(key, kind="stable")
            key, owner, u, w = key[order], owner[order], u[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
            times = np.diff(np.append(first, len(key)))
            key, owner, u, w = key[first], owner[first], u[first], w[first]
            pair = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n_docs, u, w = np.diff(np.append(pair, len(key))), u[pair], w[pair]
            spread = np.where(np.isin(u, hot), mix(w, u), mix(u, _U(7) * np.ones_like(u)))
            part = ((spread >> _U(20)) % _U(parts)).astype(np.int64)
            order = np.lexsort((w, u, part))
            pair, n_docs, u, w, part = pair[order], n_docs[order], u[order], w[order], part[order]
            ends = np.cumsum(n_docs)
            post = np.arange(ends[-1]) - np.repeat(ends - n_docs, n_docs) + np.repeat(pair, n_docs)
            owner, times = owner[post], times[post]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                if a < b:
                    us, nu = np.unique(u[a:b], return_counts=True)
                    ws, iw = np.unique(w[a:b], return_inverse=True)
                    i, j = ends[a] - n_docs[a], ends[b - 1]
                    blobs.append(pack(deltas(us), nu, deltas(ws), iw, n_docs[a:b], owner[i:j], times[i:j], teach))
                    where.append(int(numbers[p]))
            lists = [ids.to_pylist(), *[None] * (len(blobs) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([chunk] * len(blobs), pa.int64()), pa.array(lists, pa.list_(to_arrow_type(kind))),
                                              pa.array(blobs, pa.binary())], names=["part", "chunk", "ids", "blob"])

    rows = docs.select(docs[text_col].cast("binary"), docs[id_col], train)
    return rows.mapInArrow(run, f"part int, chunk long, ids array<{kind.simpleString()}>, blob binary")


def merged(rows: DataFrame) -> DataFrame:
    """Rows (part, chunk, ids, blob) with one blob for each part: its distinct pairs, their training counts and their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("none")
        held, blobs, chunk_of = None, [], []

        def one():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([0], pa.int64()), pa.array([None], ids), pa.array([_merge_blobs(blobs, chunk_of)], pa.binary())], names=names)

        for batch in batches:
            ids, names = batch.schema.field("ids").type, batch.schema.names
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != held:
                    if blobs:
                        yield one()
                    held, blobs, chunk_of = part, [], []
                if part < 0:
                    yield batch.slice(i, 1)
                else:
                    blobs.append(batch.column(3)[i].as_py()), chunk_of.append(batch.column(1)[i].as_py())
        if blobs:
            yield one()

    schema = rows.schema
    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


def _merge_blobs(blobs: list[bytes], chunk_of: list[int]) -> bytes:
    sent = [unpack(b) for b in blobs]
    us, ws = [np.cumsum(x[0], dtype=_U) for x in sent], [np.cumsum(x[2], dtype=_U) for x in sent]
    contexts, words = np.unique(np.concatenate(us)), np.unique(np.concatenate(ws))
    code = np.concatenate([np.repeat(np.searchsorted(contexts, u), x[1]) << 32 | np.searchsorted(words, w)[x[3]] for u, w, x in zip(us, ws, sent)])
    taught = np.concatenate([np.bincount(np.repeat(np.arange(len(x[4])), x[4]), x[6] * x[7][x[5]], len(x[4])).astype(np.int64) for x in sent])
    pairs, at = np.unique(code, return_inverse=True)
    n_docs = np.concatenate([x[4] for x in sent])
    owner = np.repeat(at.astype(np.int32), n_docs)
    order = np.argsort(owner, kind="stable")
    chunk = np.repeat(np.arange(len(sent), dtype=np.int32), [len(x[5]) for x in sent])
    context = pairs >> 32
    return pack(deltas(contexts), np.bincount(context, minlength=len(contexts)), deltas(words), pairs & 0xFFFFFFFF, np.bincount(at, taught, len(pairs)).astype(np.int64),
                np.bincount(owner, minlength=len(pairs)), chunk[order], np.concatenate([x[5] for x in sent])[order], np.concatenate([x[6] for x in sent])[order], np.array(chunk_of))


class Part:
    """One part of the model: distinct pairs with training counts, sorted contexts and words, and the postings of its documents."""

    def __init__(self, table: pa.Table, hot: np.ndarray):
        contexts, n_pairs, words, self.word, count, self.n_docs, self.chunk, self.doc, self.times, self.chunks = unpack(table["blob"][0].as_py())
        self.contexts, self.words, self.count = np.cumsum(contexts, dtype=_U), np.cumsum(words, dtype=_U), count.astype(np.int64)
        self.context = np.repeat(np.arange(len(n_pairs), dtype=np.int32), n_pairs)
        self.hot = np.flatnonzero(np.isin(self.contexts, hot))
        self.customers = np.bincount(self.context, self.count, len(self.contexts))

    def by_document(self, *values: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """For each chunk its documents and the sums of the pairs' values over their tokens."""
        place, at = np.unique(self.chunk.astype(np.int64) << 32 | self.doc, return_inverse=True)
        pair = np.repeat(np.arange(len(self.n_docs), dtype=np.int32), self.n_docs)
        sums = [np.bincount(at, v[pair] * self.times, len(place)) for v in values]
        ends = np.searchsorted(place >> 32, np.arange(len(self.chunks) + 1))
        for k, chunk in enumerate(self.chunks.tolist()):
            i = slice(ends[k], ends[k + 1])
            yield chunk, [place[i] & 0xFFFFFFFF, *[x[i] for x in sums]]

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, len(self.words)).astype(np.int64)

    def split(self, roots: int) -> list[np.ndarray]:
        """Word numbers for each part of the root restaurant."""
        at = ((self.words >> _U(33)) % _U(roots)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        return np.split(order, np.searchsorted(at[order], np.arange(1, roots)))


def seat(count: np.ndarray, restaurant: np.ndarray, base: np.ndarray, elsewhere: np.ndarray, discount: float, seed: int,
         samples: int = SAMPLES, burn: int = BURN) -> list[np.ndarray]:
    """Tables of each dish (``count`` customers in ``restaurant``, parent's probability ``base``) in some samples of the seating.

    A sweep takes every customer of every dish away from its table once and seats it again: at a table of its dish by its size less the
    discount, at a new one by (strength + discount * tables of the restaurant) * base. Dishes move side by side, each one customer at a
    time, given the tables before the move; a dish of over ``SINGLE`` customers moves a ``BLOCKS``-th of them at a time. ``elsewhere``
    counts tables of the restaurants in other tasks. The first sample follows ``burn`` sweeps; memory follows the customers up to
    ``SINGLE`` a dish, then the tables.
    """
    rng = np.random.default_rng(seed)
    live = np.flatnonzero(count >= 2)
    live = live[np.argsort(-count[live], kind="stable")]
    c, r, p = count[live], restaurant[live], base[live]
    total = elsewhere + np.bincount(restaurant[count == 1], minlength=len(elsewhere))
    a = (STRENGTH + discount * (total + np.bincount(r, minlength=len(total)))[r]) * p
    t = np.minimum(1 + rng.poisson(a * np.log((a + c) / (a + 1))), c)
    total = total + np.bincount(r, t, len(total))
    large = int((c > SINGLE).sum())
    groups = [_Large(c[:large], r[:large], p[:large], t[:large]), _Small(c[large:], r[large:], p[large:], t[large:])]
    out = []
    for sweep in range(burn + samples):
        if sweep:
            for group in groups:
                group.sweep(rng, discount, total)
        if sweep >= burn:
            tables = np.minimum(count, 1)
            tables[live] = np.concatenate([x.t for x in groups])
            out.append(tables)
    return out


class _Small:
    """Dishes in falling order of customers, held one by one. Customer, table or free place k of dish i lies at ``at[k] + i``."""

    def __init__(self, c: np.ndarray, r: np.ndarray, p: np.ndarray, t: np.ndarray):
        self.c, self.r, self.p, self.t = c, r, p, t.copy()
        rounds = int(c[0]) if len(c) else 0
        self.n = len(c) - np.searchsorted(c[::-1], np.arange(rounds), "right")  # dishes with more than k customers
        self.at = at = np.cumsum(self.n) - self.n
        self.table, self.free, self.size = (np.zeros(int(self.n.sum()), kind) for kind in (np.int32, np.int32, np.int16))
        for k, (n, start) in enumerate(zip(self.n.tolist(), at.tolist())):  # all but t - 1 customers at table 0, one at each other
            i = np.arange(n)
            self.table[start:start + n] = at[np.maximum(k - (c[:n] - t[:n]), 0)] + i
            self.free[start:start + n] = at[c[:n] - 1 - k] + i
            self.size[start:start + n] = np.where(k < t[:n], 1, 0) if k else c[:n] - t[:n] + 1

    def sweep(self, rng: np.random.Generator, discount: float, total: np.ndarray) -> None:
        at, table, free, size = self.at, self.table, self.free, self.size
        for k, (n, start) in enumerate(zip(self.n.tolist(), at.tolist())):
            c, r, t = self.c[:n], self.r[:n], self.t[:n]
            mine = table[start:start + n]
            size[mine] -= 1
            gone = np.flatnonzero(size[mine] == 0)
            free[at[c[gone] - t[gone]] + gone] = mine[gone]
            t[gone] -= 1
            np.subtract.at(total, r[gone], 1)
            fresh = (STRENGTH + discount * total[r]) * self.p[:n]
            to_new = rng.random(n) * (fresh + (c - 1) - discount * t) < fresh
            new = np.flatnonzero(to_new)
            place = free[at[c[new] - t[new] - 1] + new]
            stay = np.flatnonzero(~to_new)
            while len(stay):  # the table of another customer, kept by its size less the discount
                j = (rng.random(len(stay)) * (c[stay] - 1)).astype(np.int64)
                other = table[at[j + (j >= k)] + stay]
                s = size[other]
                kept = (t[stay] == 1) | (rng.random(len(stay)) * s < s - discount)
                mine[stay[kept]] = other[kept]
                stay = stay[~kept]
            mine[new] = place
            t[new] += 1
            size[mine] += 1
            np.add.at(total, r[new], 1)


class _Large:
    """Dishes held as the sizes of their tables and how many customers of each have yet to move in this sweep."""

    def __init__(self, c: np.ndarray, r: np.ndarray, p: np.ndarray, t: np.ndarray):
        self.c, self.r, self.p, self.t = c, r, p, t.copy()
        self.dish, self.size = np.repeat(np.arange(len(c)), t), np.ones(int(t.sum()), np.int64)
        self.size[np.cumsum(t) - t] = c - t + 1

    def sweep(self, rng: np.random.Generator, discount: float, total: np.ndarray) -> None:
        """In blocks that share out all customers. Those of a block do not see each other's new places."""
        if not len(self.c):
            return
        n_dishes, waiting = len(self.c), self.size.copy()
        for left in range(BLOCKS, 0, -1):
            leave = rng.binomial(waiting, 1 / left)
            n = np.bincount(self.dish, leave, n_dishes).astype(np.int64)
            rest = self.size - leave
            some = rest > 0
            dish, size, waiting = self.dish[some], rest[some], (waiting - leave)[some]
            t = np.bincount(dish, minlength=n_dishes)
            np.add.at(total, self.r, t - self.t)
            fresh = (STRENGTH + discount * total[self.r]) * self.p
            new = rng.binomial(n, np.where(t > 0, fresh / (fresh + np.maximum(self.c - 1 - discount * t, 0)), 1.0))
            upto, first, stay = np.cumsum(size - discount), np.cumsum(t) - t, n - new
            low, high = np.append(0.0, upto)[first], np.append(0.0, upto)[first + t]
            many = np.flatnonzero(stay > CROWD)
            for i in many:
                here = slice(first[i], first[i] + t[i])
                size[here] += rng.multinomial(stay[i], (size[here] - discount) / (size[here] - discount).sum())
            stay[many] = 0
            who = np.repeat(np.arange(n_dishes), stay)
            at = np.searchsorted(upto, low[who] + rng.random(len(who)) * (high - low)[who], "right")
            size += np.bincount(np.clip(at, first[who], first[who] + t[who] - 1), minlength=len(size))
            ends = first + t  # new tables follow those of their dish
            self.dish, self.size, waiting = np.insert(dish, np.repeat(ends, new), np.repeat(np.arange(n_dishes), new)), np.insert(size, np.repeat(ends, new), 1), np.insert(waiting, np.repeat(ends, new), 0)
            self.t = t + new
            np.add.at(total, self.r, new)


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate from how many counts are one and two."""
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def root_predictive(customers, tables, sums: dict, discount: float) -> np.ndarray:
    """Probabilities of words in the root restaurant; its base is even over all words and one for the unknown."""
    even = (STRENGTH + discount * sums["tables"]) / (sums["words"] + 1)
    return (customers - discount * tables + even) / (STRENGTH + sums["customers"])


class Model:
    """The sampler over stored postings: parts hold restaurants of contexts, roots hold words; they exchange counts of words.

    Holds only numbers and hot words, so that tasks can have it.
    """

    def __init__(self, hot: np.ndarray, parts: int, seed: int):
        self.hot, self.seed, self.roots = hot, seed, max(1, parts // 4)

    def _send(self, part: int, of: Part, values: list[np.ndarray], extra: np.ndarray, keep: list[np.ndarray] = ()) -> pa.Table:
        """A row for each root with the words' values, one row (root -1) of numbers for the driver, one (root -2) that the part keeps."""
        rows = [(part, k, pack(deltas(of.words[i[np.argsort(of.words[i])]]), *[v[i[np.argsort(of.words[i])]] for v in values])) for k, i in enumerate(of.split(self.roots)) if len(i)]
        rows += [(part, -1, pack(extra)), *([(part, -2, pack(*keep))] if len(keep) else [])]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "root": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    _ROWS = "part int, root int, blob binary"

    def _numbers(self, rows: DataFrame) -> np.ndarray:
        """The sum of the driver's rows: a few numbers from each part or root."""
        found = [unpack(r["blob"])[0].astype(np.float64) for r in rows.select("blob").collect()]
        return np.sum(found, axis=0) if found else np.zeros(4 + 8 * (len(self.hot) + SAMPLES))

    def count(self, table: DataFrame) -> DataFrame:
        """Counts of words over all parts; every dish at one table. Returns the roots' replies."""
        hot = self.hot

        def run(table: pa.Table) -> pa.Table:
            part = Part(table, hot)
            c, ones = part.count, np.minimum(part.count, 1)
            extra = np.zeros((2, len(hot)))
            extra[:, np.searchsorted(hot, part.contexts[part.hot])] = [part.customers[part.hot], np.bincount(part.context, ones, len(part.contexts))[part.hot]]
            return self._send(table["part"][0].as_py(), part, [part.by_word(c), part.by_word(ones)], np.concatenate([[(c == 1).sum(), (c == 2).sum()], extra.ravel()]))

        sent = cut(table.groupBy("part").applyInArrow(run, self._ROWS))
        n = self._numbers(sent.filter("root < 0"))
        self.discount, self.hot_customers, self.hot_tables = discount_of(*n[:2]), n[2:2 + len(hot)], n[2 + len(hot):2 + 2 * len(hot)]

        def root(table: pa.Table) -> pa.Table:
            words, (c, t), back = _merge(table)
            sums = np.array([(c > 0).sum(), c.sum(), t.sum(), (t == 1).sum(), (t == 2).sum()])
            return _reply(table, [c, t], back, sums)

        first = cut(sent.filter("root >= 0").groupBy("root").applyInArrow(root, self._ROWS))
        words, tokens, customers, ones, twos = self._numbers(first.filter("part < 0"))[:5]
        self.sums = {"words": int(words), "tokens": int(tokens), "customers": customers, "tables": words}
        self.root_discount = discount_of(ones, twos)
        return first

    def _seated(self, part: Part, number: int, first: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
        """The sampled tables of all pairs."""
        _, t = part_values(part, self.roots, first, 2)
        base = root_predictive(t, np.minimum(t, 1), self.sums, self.root_discount)
        elsewhere = np.zeros(len(part.contexts))
        mine = np.bincount(part.context, np.minimum(part.count, 1), len(part.contexts))
        elsewhere[part.hot] = self.hot_tables[np.searchsorted(self.hot, part.contexts[part.hot])] - mine[part.hot]
        return seat(part.count, part.context, base[part.word], elsewhere, self.discount, self.seed * 1_000_003 + number)

    def sample(self, table: DataFrame, first: DataFrame) -> DataFrame:
        """Seat all context restaurants given the root, then the root given their tables. Returns the roots' replies and the parts' tables (root -2)."""
        hot = self.hot

        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            number, part = table["part"][0].as_py(), Part(table, hot)
            tables = self._seated(part, number, _by_root(replies))
            extra = np.zeros((SAMPLES, len(hot)))
            for s, t in enumerate(tables):
                extra[s, np.searchsorted(hot, part.contexts[part.hot])] = np.bincount(part.context, t, len(part.contexts))[part.hot]
            return self._send(number, part, [part.by_word(t) for t in tables], extra.ravel(), tables)

        replies = first.filter("part >= 0").groupBy("part")
        sent = cut(table.groupBy("part").cogroup(replies).applyInArrow(run, self._ROWS))
        self.hot_sampled = self._numbers(sent.filter("root = -1"))[:SAMPLES * len(hot)].reshape(SAMPLES, -1)
        words, every, discount, seed = self.sums["words"], self.sums["tables"], self.root_discount, self.seed

        def root(table: pa.Table) -> pa.Table:
            _, customers, back = _merge(table)
            seats = [seat(c, np.zeros(len(c), np.int64), np.full(len(c), 1 / (words + 1)), np.array([every - (c > 0).sum()]), discount,
                          seed * 999_983 + 7 * table["root"][0].as_py() + s, samples=1)[0] for s, c in enumerate(customers)]
            return _reply(table, [*customers, *seats], back, np.array([x.sum() for x in (*customers, *seats)]))

        second = cut(sent.filter("root >= 0").groupBy("root").applyInArrow(root, self._ROWS))
        n = self._numbers(second.filter("part < 0"))
        self.sampled = [{"words": words, "customers": n[s], "tables": n[SAMPLES + s]} for s in range(SAMPLES)]
        return second.unionByName(sent.filter("root = -2"))

    def scores(self, table: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
        """(chunk, blob) rows from each part: documents of the chunk, log10 probabilities of their tokens in this part, the base's, known tokens."""
        hot, n, words = self.hot, self.sums["tokens"], self.sums["words"]

        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            number, part = table["part"][0].as_py(), Part(table, hot)
            is_first = replies["round"].to_numpy() == 1
            c, _ = part_values(part, self.roots, _by_root(replies.filter(pa.array(is_first))), 2)
            replies = _by_root(replies.filter(pa.array(~is_first)))
            tables = [t.astype(np.int64) for t in replies.pop(-2)]
            late = part_values(part, self.roots, replies, 2 * SAMPLES)
            at = np.searchsorted(hot, part.contexts[part.hot])
            customers = part.customers.copy()
            customers[part.hot] = self.hot_customers[at]
            p = np.zeros(len(part.count))
            for s, t in enumerate(tables):
                total = np.bincount(part.context, t, len(part.contexts))
                total[part.hot] = self.hot_sampled[s][at]
                root = root_predictive(late[s], late[SAMPLES + s], self.sampled[s], self.root_discount)
                p += (part.count - self.discount * t + (STRENGTH + self.discount * total)[part.context] * root[part.word]) / (STRENGTH + customers)[part.context]
            score = np.log10(p / SAMPLES)
            base = np.log10((c + 0.5) / (n + 0.5 * (words + 1)))[part.word]
            known = (c > 0)[part.word]
            out, chunk_of = [], []
            for chunk, (docs, *sums) in part.by_document(score, base, known):
                out.append(pack(docs, sums[0], sums[1], sums[2].astype(np.int64))), chunk_of.append(chunk)
            return pa.table({"chunk": pa.array(chunk_of, pa.int64()), "blob": pa.array(out, pa.binary())})

        replies = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2))).filter("part >= 0")
        return table.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(run, "chunk long, blob binary")


def _merge(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of all senders, their summed values, and where each sender's words are."""
    sent = [unpack(b.as_py()) for b in table["blob"]]
    words = [np.cumsum(s[0], dtype=_U) for s in sent]
    all_, back = np.unique(np.concatenate(words), return_inverse=True)
    values = [np.bincount(back, np.concatenate([s[1 + v] for s in sent]), len(all_)).astype(np.int64) for v in range(len(sent[0]) - 1)]
    return all_, values, np.split(back, np.cumsum([len(w) for w in words])[:-1])


def _reply(table: pa.Table, values: list[np.ndarray], back: list[np.ndarray], sums: np.ndarray) -> pa.Table:
    root = table["root"][0].as_py()
    blobs = [pack(*[v[i] for v in values]) for i in back]
    return pa.table({"part": pa.array([*table["part"].to_pylist(), -1], pa.int32()), "root": pa.array([root] * (len(blobs) + 1), pa.int32()),
                     "blob": pa.array([*blobs, pack(sums.astype(np.float64))], pa.binary())})


def _by_root(replies: pa.Table) -> dict[int, list[np.ndarray]]:
    return {r: unpack(b) for r, b in zip(replies["root"].to_pylist(), replies["blob"].to_pylist())}


def part_values(part: Part, roots: int, replies: dict[int, list[np.ndarray]], n: int) -> list[np.ndarray]:
    """The roots' values in the order of the part's words."""
    out = [np.zeros(len(part.words), np.int64) for _ in range(n)]
    for k, i in enumerate(part.split(roots)):
        if len(i):
            i = i[np.argsort(part.words[i])]
            for v, got in zip(out, replies[k]):
                v[i] = got
    return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """One row per document: id, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10), ``perplexity``.

    Tokens are words (A-Z in lower case) and one end. Each word is a restaurant over the next word; all of them share the restaurant of
    single words as parent, whose base is even over the words learnt and one unknown. Documents with ``train`` teach; all of their pairs
    are counted. Restaurants are seated by Gibbs sampling, contexts given the root's probabilities, then the root given their tables, and the
    predictive probabilities of ``SAMPLES`` samples are averaged. Discounts follow from the counts of ones and twos.

    Null and empty texts are one end; ids may repeat or be null (each row is scored); without training rows words are unknown and every token
    has the even probability; an empty table gives an empty one. Words meet by 64-bit hashes. Extra columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(docs[text_col])).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // PART_BYTES))
    hot = hot_words(docs.select(docs[text_col].cast("binary")), parts) if parts > 1 else np.zeros(0, _U)
    name = f"postings_{uuid.uuid4().hex[:12]}"
    rows = postings(docs, train, slots(spark, parts), hot, id_col, text_col)
    merged(rows.repartition(parts, "part").sortWithinPartitions("part")).write.bucketBy(parts, "part").option("path", new_path(spark, "postings")).saveAsTable(name)
    try:
        table = spark.table(name)
        blobs = table.filter("part >= 0").select("part", "blob")
        model = Model(hot, parts, seed)
        first = model.count(blobs)
        parts_of = model.scores(blobs, first, model.sample(blobs, first))
        kind, tokens = docs.schema[id_col].dataType, model.sums["tokens"]

        def add(docs: pa.Table, scores: pa.Table) -> pa.Table:
            ids = docs["ids"].combine_chunks().flatten()
            sizes, teach = unpack(docs["blob"][0].as_py())
            total, base, known = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
            for blob in scores["blob"]:
                i, *values = unpack(blob.as_py())
                for out, v in zip((total, base, known), values):
                    out[i] += v.astype(out.dtype)
            return pa.table({id_col: ids, "train": pa.array(teach.astype(bool)), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(known),
                             "train_tokens": pa.array(np.full(len(sizes), tokens)), "base_score": pa.array(base), "score": pa.array(total),
                             "perplexity": pa.array(10.0 ** np.minimum(-total / sizes, 300))})

        schema = f"`{id_col}` {kind.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
        whole = table.filter("part < 0").select("chunk", "ids", "blob").groupBy("chunk")
        return cut(whole.cogroup(parts_of.groupBy("chunk")).applyInArrow(add, schema))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
