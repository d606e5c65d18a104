"""Removal of byte strings that an earlier document holds too: suffix sorting with threshold-bounded interval expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, new_path
from . import caches

#: Bytes of an anchor, text bytes of a batch, positions that are scanned at a time, shares of the keys for each shuffle partition.
GRAM, BATCH_BYTES, CHUNK, SHARES = 20, 1 << 20, 1 << 20, 8
#: Symbols of differing texts that are suffix-sorted together; one anchor's texts stay together.
SYMBOLS = 500_000
_LAST = np.iinfo(np.int64).max
_U = np.uint64
_A = 0x9E3779B97F4A7C15
_INVERSE = pow(_A, -1, 1 << 64)
_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=_U)
_LOW40 = _U((1 << 40) - 1)


def _power(a: int, n: int) -> np.uint64:
    return _U(pow(a, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


_POWERS: dict[int, np.ndarray] = caches.held("powers", {})


def _powers(a: int, n: int) -> np.ndarray:
    if a not in _POWERS or len(_POWERS[a]) < n:
        x = np.full(max(n, CHUNK + 4096), _U(a), _U)
        x[0] = 1
        _POWERS[a] = np.multiply.accumulate(x)
    return _POWERS[a][:n]


def string_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings at ``start``."""
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * _powers(_A, len(data)), out=total[1:])
    return _mix((total[start + length] - total[start]) * _powers(_INVERSE, len(data) + 1)[start] + length.astype(_U))


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each stretch of ``width`` values."""
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = op(x[:len(x) - size], x[size:])
        size *= 2
    return op(x[:n], x[width - size:width - size + n])


def anchors(data: np.ndarray, end: np.ndarray, length: int, gram: int, shares: int, wanted: np.ndarray | None = None):
    """The anchors of a buffer of documents: chunks of (position, key), with ``wanted`` keys also (first window, windows, hash).

    A window is a string of ``length`` bytes inside one document (``end``: of the document at each byte). Its anchor is the gram
    of smallest hash in it, so equal windows anywhere have the same anchor at the same place in them. Keys hold their
    share in the bits above 40.
    """
    width, n = length - gram + 1, len(data)
    for s in range(0, max(n - length + 1, 0) + width, CHUNK):
        low, high = max(0, s - width + 1), min(n, s + CHUNK + length)
        part = data[low:high]
        if len(part) < length:
            break
        h, size, parts = _TABLE[part], 1, []
        while size <= gram:
            if gram & size:
                parts.append((size, h))
            h = h[:len(h) - size] * _power(_A, size) + h[size:]
            size *= 2
        out, at, m = np.zeros(len(part) - gram + 1, _U), 0, len(part) - gram + 1
        for size, x in reversed(parts):
            out = out * _power(_A, size) + x[at:at + m]
            at += size
        h = _mix(out) | _U(1)
        least = _slide(h, width, np.minimum)
        least[end[low:low + len(least)] - np.arange(low, low + len(least)) < length] = 0
        padded = np.zeros(len(least) + 2 * (width - 1), _U)
        padded[width - 1:width - 1 + len(least)] = least
        chosen = _slide(padded, width, np.maximum) == h
        chosen[:s - low] = False
        chosen[s - low + CHUNK:] = False
        at = np.flatnonzero(chosen)
        key = h[at]
        key = ((key >> _U(40)) % _U(shares)) << _U(40) | key & _LOW40
        if wanted is None:
            yield at + low, key
            continue
        hit = np.isin(key, wanted)
        at, key = at[hit], key[hit]
        own = padded[at[:, None] + np.arange(width)] == h[at][:, None]
        first, count = at - width + 1 + own.argmax(axis=1), own.sum(axis=1)
        yield at + low, key, first + low, count, string_hashes(part, first, count + length - 1)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols or more (by doubling); symbols below 512, 0 ends a string."""
    n = len(text)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = text
    key, size = np.zeros(n, np.int64), 7
    for k in range(7):
        key = key << 9 | padded[k:k + n]
    while True:
        order = np.argsort(key, kind="stable")
        if size >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, sorted_key[1:] != sorted_key[:-1]])
        after = np.zeros(n, np.int64)
        after[:n - size] = rank[size:]
        key, size = rank << 32 | after, size * 2


def common_prefix_breaks(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """True at i where suffix ``order[i]`` shares fewer than ``depth`` symbols with the one before it.

    Breadth-first over the intervals of the Burrows-Wheeler transform: from the interval of all suffixes, every interval of a
    string w is extended backwards to the intervals of c w; the border right of such an interval that no shorter string has
    set gets the common prefix |w| and the interval goes on to the next level. Levels end at ``depth``; borders then unset have a
    common prefix of at least ``depth``. Strings with an end mark (0) are left out, as no whole window holds one.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = text[order - 1].astype(np.int64)  # of suffix 0: the final end mark
    step = place[order - 1]
    breaks = np.zeros(n + 1, bool)
    breaks[0] = breaks[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(depth):
        if not len(low):
            break
        size = high - low + 1
        which = np.repeat(np.arange(len(low)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - low, size)
        key = which << 9 | before[at]
        real = before[at] > 0
        key, to = key[real], step[at[real]]
        by = np.argsort(key, kind="stable")
        key, to = key[by], to[by]
        if not len(key):
            break
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low, high = np.minimum.reduceat(to, first), np.maximum.reduceat(to, first)
        new = ~breaks[high + 1]
        low, high = low[new], high[new]
        breaks[high + 1] = True
    return breaks[:n]


def repeated_windows(text: np.ndarray, owner: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows that another string with a smaller owner holds too. ``left``: bytes up to the string's end mark."""
    order = suffix_order(text, length)
    breaks = common_prefix_breaks(text, order, length)
    group, whole = np.cumsum(breaks)[left[order] >= length], order[left[order] >= length]
    if not len(whole):
        return whole
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.repeat(np.minimum.reduceat(owner[whole], first), np.diff(np.r_[first, len(whole)]))
    return np.sort(whole[owner[whole] > least])


def _blob(x, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first, count)


def _meeting(key: np.ndarray, size: np.ndarray, most: int = SYMBOLS) -> Iterator[np.ndarray]:
    """Indices of strings whose (sorted) key others share too, in portions of about ``most`` symbols that split no key."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    several = np.flatnonzero(count > 1)
    if not len(several):
        return
    portion = np.cumsum(np.add.reduceat(size, first)[several]) // most
    for group in np.split(several, np.flatnonzero(np.diff(portion)) + 1):
        yield _ranges(first[group], count[group])


def _partly_repeated(data: np.ndarray, at: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int):
    """(string, offset, size) of the stretches of different strings that one with a smaller owner holds too."""
    n = size + 1
    begin = np.cumsum(n) - n
    string = np.repeat(np.arange(len(n), dtype=np.int32), n)
    inside = np.arange(int(n.sum())) - begin[string]
    left = size[string] - inside
    symbols = np.where(left > 0, data[np.minimum(at[string] + inside, len(data) - 1)].astype(np.int16) + 1, 0).astype(np.int16)
    hit = repeated_windows(symbols, owner[string], left, length)
    if not len(hit):
        return hit, hit, hit
    new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (string[hit[1:]] != string[hit[:-1]])]
    a, z = hit[new], hit[np.r_[new[1:], True]]
    return string[a], inside[a], z - a + length


def _packed(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """The documents in batches by a hash of their rows, stored so that a join by batch moves no text."""
    total = docs.agg(F.sum(F.octet_length(docs[text_col]) + 1)).first()[0] or 0
    n = max(1, -(-total // BATCH_BYTES))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text"))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id", F.octet_length("text"), F.substring("text", 1, 64)), F.lit(n)).cast("long"))
    rows = rows.repartition(parts, "b").sortWithinPartitions("b", F.col("id").asc_nulls_last())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts = None, [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                                               pa.array([b"".join(texts)], pa.binary())], names=["b", "ids", "sizes", "text"])
        for batch in batches:
            for b, i, t in zip(batch.column("b").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if b != now and ids:
                    yield row()
                    ids, texts = [], []
                now = b
                ids.append(i), texts.append(t or b"")
        if ids:
            yield row()

    spark = docs.sparkSession
    path = new_path(spark, "batches")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    made = rows.mapInArrow(pack, "b long, ids array<long>, sizes array<long>, text binary")
    made.write.bucketBy(parts, "b").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


class _Batch:
    def __init__(self, batch: pa.RecordBatch, row: int):
        col = lambda n: batch.column(n)[row].as_py()
        self.b, self.ids, sizes = col("b"), col("ids"), np.array(col("sizes"), np.int64)
        self.text = col("text")
        self.data = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum(sizes)
        self.end = np.repeat(self.ends, sizes)
        self.order = np.array([_LAST if i is None else i for i in self.ids], np.int64)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def _each(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch, row


def _concat(blobs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _shared_keys(table: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """For each batch the keys of its anchors that more than one document has: rows (b, keys)."""
    shares = parts * SHARES

    def emit(batches):
        caches.only("powers")
        for batch, row in _each(batches):
            x = _Batch(batch, row)
            found = list(anchors(x.data, x.end, length, gram, shares))
            at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            key = np.concatenate([f[1] for f in found]) if found else np.zeros(0, _U)
            if not len(key):
                continue
            by = np.argsort(key, kind="stable")
            key, doc = key[by], x.doc(at[by])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            key = key[first]
            share = (key >> _U(40)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]]).tolist()
            low = key.view(np.uint8).reshape(-1, 8)[:, :5]
            q, keys, more = [], [], []
            for s, e in zip(starts, [*starts[1:], len(key)]):
                q.append(int(share[s])), keys.append(low[s:e].tobytes()), more.append(many[s:e].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([x.b] * len(q), pa.int64()), pa.array(keys, pa.binary()), pa.array(more, pa.binary())],
                                             names=["q", "b", "keys", "more"])

    def meet(batches):
        keys, owners, many = [], [], []
        for batch, row in _each(batches):
            q, b, k, m = (batch.column(n)[row].as_py() for n in ("q", "b", "keys", "more"))
            wide = np.zeros((len(m), 8), np.uint8)
            wide[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
            keys.append(wide.view(_U).ravel() | _U(q) << _U(40))
            owners.append(np.full(len(m), b))
            many.append(np.frombuffer(m, bool))
        if not keys:
            return
        key, owner, more = map(np.concatenate, (keys, owners, many))
        by = np.argsort(key, kind="stable")
        key, owner, more = key[by], owner[by], more[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[first, len(key)])
        hit = np.repeat((count > 1) | np.logical_or.reduceat(more, first), count)
        key, owner = key[hit], owner[hit]
        by = np.argsort(owner, kind="stable")
        key, owner = key[by], owner[by]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
        for at in range(0, len(starts), 1000):
            s, e = starts[at:at + 1000], np.r_[starts[1:], len(owner)][at:at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(owner[s]), pa.array([key[i:j].tobytes() for i, j in zip(s, e)], pa.binary())], names=["b", "keys"])

    sent = table.mapInArrow(emit, "q int, b long, keys binary, more binary").repartition(parts, "q")
    return sent.mapInArrow(meet, "b long, keys binary")


def _covered(table: DataFrame, keys: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """For each batch the stretches of its buffer that an earlier document repeats: rows (b, start, size)."""
    shares = parts * SHARES

    def emit(batches):
        caches.only("powers")
        for batch, row in _each(batches):
            x = _Batch(batch, row)
            wanted = np.unique(_concat(batch.column("keys")[row].as_py(), _U))
            found = [f for f in anchors(x.data, x.end, length, gram, shares, wanted) if len(f[0])]
            if not found:
                continue
            at, key, first, count, digest = map(np.concatenate, zip(*found))
            size, owner = count + length - 1, x.order[x.doc(at)]
            by = np.lexsort((owner, digest, key))
            key, first, size, digest, owner = key[by], first[by], size[by], digest[by], owner[by]
            head = np.r_[True, (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])]
            group = np.cumsum(head) - 1
            later = owner > owner[head][group]  # an earlier document of the batch has the same string
            q, b, cols = [], [], [[] for _ in range(7)]
            if later.any():
                q.append(x.b % shares), b.append(x.b)
                for c, v in zip(cols, (b"", b"", b"", b"", _blob(first[later], "<i8"), _blob(size[later], "<i4"), b"")):
                    c.append(v)
            heads, uses = np.flatnonzero(head), np.bincount(group[~later], minlength=int(head.sum()))
            starts, share = first[~later], (key[heads] >> _U(40)).astype(np.int64)
            use_at = np.r_[0, np.cumsum(uses)]
            cuts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(heads)]):
                mine = heads[s:e]
                text = b"".join([x.text[i:i + n] for i, n in zip(first[mine].tolist(), size[mine].tolist())])
                q.append(int(share[s])), b.append(x.b)
                for c, v in zip(cols, (_blob(key[mine], "<u8"), _blob(owner[mine], "<i8"), text, _blob(uses[s:e], "<i4"),
                                       _blob(starts[use_at[s]:use_at[e]], "<i8"), _blob(size[mine], "<i4"), _blob(digest[mine], "<u8"))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int64()), *[pa.array(c, pa.binary()) for c in cols]],
                                             names=["q", "b", "key", "owner", "text", "uses", "start", "size", "digest"])

    def meet(batches):
        key, owner, text, uses, start, size, digest, home = ([] for _ in range(8))
        for batch, row in _each(batches):
            b, k, o, t, u, s, z, d = (batch.column(n)[row].as_py() for n in ("b", "key", "owner", "text", "uses", "start", "size", "digest"))
            if not k:  # settled in the batch
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([s], pa.binary()), pa.array([z], pa.binary())], names=["b", "start", "size"])
                continue
            key.append(k), owner.append(o), text.append(t), uses.append(u), start.append(s), size.append(z), digest.append(d)
            home.append(np.full(len(k) // 8, b))
        if not key:
            return
        key, owner, uses, start, size = _concat(key, "<u8"), _concat(owner, "<i8"), _concat(uses, "<i4").astype(np.int64), _concat(start, "<i8"), _concat(size, "<i4").astype(np.int64)
        digest, home, data = _concat(digest, "<u8"), np.concatenate(home), np.frombuffer(b"".join(text), np.uint8)
        at, use_at = np.cumsum(size) - size, np.cumsum(uses) - uses
        by = np.lexsort((owner, digest, key))
        head = np.r_[True, (key[by][1:] != key[by][:-1]) | (digest[by][1:] != digest[by][:-1])]
        group, heads = np.cumsum(head) - 1, by[head]
        later = owner[by] > owner[heads][group]
        # runs: which string, where in it, how long
        runs = [(by[later], np.zeros(int(later.sum()), np.int64), size[by[later]])]
        # the same string elsewhere in the same document, or in one with the same id, loses the same bytes
        members = np.bincount(group[~later], minlength=len(heads))
        equal, member_at = by[~later], np.cumsum(members) - members
        for part in _meeting(key[heads], size[heads] + 1):
            which, offset, run = _partly_repeated(data, at[heads[part]], size[heads[part]], owner[heads[part]], length)
            times = members[part[which]]
            runs.append((equal[_ranges(member_at[part[which]], times)], np.repeat(offset, times), np.repeat(run, times)))
        which, offset, run = map(np.concatenate, zip(*runs))
        times = uses[which]
        pick = _ranges(use_at[which], times)
        b, begin, run = np.repeat(home[which], times), start[pick] + np.repeat(offset, times), np.repeat(run, times)
        by = np.argsort(b, kind="stable")
        b, begin, run = b[by], begin[by].astype("<i8"), run[by].astype("<i4")
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]).tolist() if len(b) else []
        ends = [*cuts[1:], len(b)]
        for i in range(0, len(cuts), 1000):
            span = list(zip(cuts[i:i + 1000], ends[i:i + 1000]))
            yield pa.RecordBatch.from_arrays([pa.array([int(b[s]) for s, _ in span], pa.int64()), pa.array([begin[s:e].tobytes() for s, e in span], pa.binary()),
                                              pa.array([run[s:e].tobytes() for s, e in span], pa.binary())], names=["b", "start", "size"])

    lists = keys.groupBy("b").agg(F.collect_list("keys").alias("keys"))
    sent = table.join(lists.hint("shuffle_hash"), "b").mapInArrow(emit, "q int, b long, key binary, owner binary, text binary, uses binary, start binary, size binary, digest binary")
    return sent.repartition(parts, "q").mapInArrow(meet, "b long, start binary, size binary")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``removed`` (array of start and end, in bytes) and ``kept`` (binary).

    A byte is removed if a string of ``length`` bytes over it also starts in a document with a smaller id (integers). Strings do not
    cross documents and are judged on the input.

    Texts are packed into batches once. Every string has an anchor gram; anchors that one document alone holds are dropped, and the
    text around the others is dealt out by anchor, equal texts once per batch, so a passage that very many documents share arrives
    once per batch. Under each share of the anchors different texts are suffix-sorted, and ``common_prefix_breaks`` finds the
    groups that agree in ``length`` bytes.

    Null texts are empty. Null ids rank behind all others; documents with equal ids (or both null) remove nothing from one
    another. An empty table gives an empty one. Documents shorter than ``length`` stay whole.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = _packed(docs, id_col, text_col, parts)
    keys = cut(_shared_keys(table, length, gram, parts))
    spans = cut(_covered(table, keys, length, gram, parts))

    def strip(batches):
        for batch, row in _each(batches):
            x = _Batch(batch, row)
            mark = np.zeros(len(x.data) + 1, np.int32)
            if (found := batch.column("starts")[row].as_py()):
                begin, run = _concat(found, "<i8"), _concat(batch.column("runs")[row].as_py(), "<i4")
                np.add.at(mark, begin, 1)
                np.add.at(mark, begin + run, -1)
            gone = np.cumsum(mark[:-1]) > 0
            kept, begins, ends, s = [], [], [], 0
            for e in x.ends.tolist():
                edge = np.flatnonzero(np.diff(np.r_[False, gone[s:e], False].astype(np.int8)))
                begins.append(edge[::2].tolist()), ends.append(edge[1::2].tolist())
                kept.append(x.data[s:e][~gone[s:e]].tobytes())
                s = e
            yield pa.RecordBatch.from_arrays([pa.array(x.ids, pa.int64()), pa.array(np.diff(np.r_[0, x.ends])), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                                             names=["id", "n_bytes", "start", "end", "kept"])

    lists = spans.groupBy("b").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("runs"))
    out = table.join(lists.hint("shuffle_hash"), "b", "left").mapInArrow(strip, "id long, n_bytes long, start array<long>, end array<long>, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", F.arrays_zip("start", "end").alias("removed"), "kept")
