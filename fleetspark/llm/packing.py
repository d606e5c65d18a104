"""Best-fit packing of tokenised documents into sequences by minimum bin slack."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from . import caches
from .frames import draw, rank_in_groups

#: Entries of a generation of a worker's caches; two generations are held.
CACHE_WORDS, CACHE_PIECES = 350_000, 200_000
#: Characters for which lower case and composed form are plain: no combining marks, no special cases.
_PLAIN = re.compile(r"[\x21-\x7eÀ-įı-ɏ]+")


class WordIds:
    """Token ids of a text, word by word through a cache.

    The tokenizer drops white space, so what stands between white space is encoded alone. Equal to encoding whole texts.
    """

    def __init__(self, path: str, end_of_word: str = "</w>"):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(end_of_word)]] = True
        self.words, self.pieces = Generations(CACHE_WORDS), Generations(CACHE_PIECES)

    def _learn(self, chunks: set[bytes]) -> None:
        """Fill the cache for all these at once."""
        plain, other = {}, []
        for c in chunks:
            text = c.decode(errors="replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                plain[c] = self.parts.findall(text.lower())
            else:
                other.append((c, text))
        new = self.pieces.missing({p for ps in plain.values() for p in ps})
        batches = [new[i:i + 50] for i in range(0, len(new), 50)]
        for batch, e in zip(batches, self.tokenizer.encode_batch_fast([" ".join(b) for b in batches], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) != len(batch):
                raise ValueError("a word has no end mark")
            raw, start = ids.tobytes(), 0
            for word, end in zip(batch, (at * 4).tolist()):
                self.pieces[word] = raw[start:end]
                start = end
        for c, ps in plain.items():
            self.words[c] = b"".join([self.pieces[p] for p in ps])
        for (c, _), e in zip(other, self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)):
            self.words[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [t.split() for t in texts]
        needed = set().union(*split)
        if len(needed) > CACHE_WORDS and len(texts) > 1:
            half = len(texts) // 2
            return self.encode(texts[:half]) + self.encode(texts[half:])
        new = self.words.missing(needed)
        if new:
            self._learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


class Generations(dict):
    """A cache that turns into the old generation when it is full; what is asked for again comes back from there."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that neither generation has; the others, and room for these, are in the new one afterwards."""
        ask = {k for k in keys if k not in self}  # set.difference would walk the whole cache
        if len(self) + len(ask) > self.most:
            self.old = dict(self)
            super().clear()
            ask = keys
        back = ask & self.old.keys()
        for k in back:
            self[k] = self.old[k]
        return list(ask - back)

    def clear(self) -> None:
        super().clear()
        self.old = {}


_LOADED: dict[str, WordIds] = caches.held("tokens", {})


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, and with ``with_ids`` its ``ids`` (binary, little-endian
    unsigned 32-bit).

    A document is its token ids and ``end_id``; only one longer than ``capacity`` is cut, into full pieces and a rest. Null and
    empty texts are the end id alone. Batches are small, so memory follows the longest text, not the table.
    """
    kind = docs.schema[id_col].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("tokens")
        coder, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(coder.encode([t or b"" for t in batch.column(1).to_pylist()])):
                    raw += end
                    for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[s:s + 4 * capacity]
                        row.append(i), piece.append(k), start.append(s // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names)

    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    cols = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    return cols.mapInArrow(pieces, f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (times, {length: copies}), each the fullest that the lengths then left allow.

    A bin takes the longest piece left; a bitset of reachable sums over the other lengths (with their counts) gives the
    fullest total, which is traced back and removed as often as the counts allow. Work depends on the number of
    different lengths, at most ``capacity``, never on the number of pieces.
    """
    left, bins = dict(counts), []
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        room = capacity - top
        reach, goal, mask, layers = 1, 1 << room, (1 << (room + 1)) - 1, []
        for n in order:
            if n > room:
                continue
            copies, k = min(left[n] - (n == top), room // n), 1
            while copies > 0 and not reach & goal:
                k = min(k, copies)
                layers.append((n, k, reach))
                reach = (reach | reach << (n * k)) & mask
                copies -= k
                k *= 2
            if reach & goal:
                break
        total, used = reach.bit_length() - 1, {top: 1}
        for n, k, before in reversed(layers):
            if not before >> total & 1:
                total -= n * k
                used[n] = used.get(n, 0) + k
        times = min(left[n] // k for n, k in used.items())
        bins.append((times, used))
        for n, k in used.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return bins


def place(pieces: DataFrame, capacity: int = 2048, seed: str = "pack") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored ``pieces`` (``id``, ``piece``, ``length`` and any other columns).

    Only the count of each length (at most ``capacity`` of them) goes to the driver, which plans bins; the plan, again bounded
    by the capacity, goes to the tasks. A piece's rank among those of its length says which copy in which bin it is.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, sequence = {}, 0
    for times, used in minimum_slack(counts, capacity):
        offset = 0
        for n, k in used.items():
            rows = table.setdefault(n, [])
            first = rows[-1][0] + rows[-1][1] * rows[-1][4] if rows else 0
            rows.append((first, k, sequence, offset, times))
            offset += n * k
        sequence += times
    plan = pieces.sparkSession.sparkContext.broadcast({n: np.array(rows, np.int64).T for n, rows in table.items()})
    ranked = rank_in_groups(pieces.withColumn("_u", draw(seed, F.col("id"), F.col("piece"))), "length", "_u", ["id", "piece"])
    keep = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, copies, base, start, _ = plan.value[int(n)]
                k = np.searchsorted(first, rank[at], "right") - 1
                nth = rank[at] - first[k]
                sequence[at] = base[k] + nth // copies[k]
                offset[at] = start[k] + nth % copies[k] * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return ranked.select(*[f"`{c}`" for c in keep], "_rank").mapInArrow(slots, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = True) -> DataFrame:
    """Pieces with ``ids``, ``ids_crc32``, ``sequence_id`` and ``offset`` (place in the sequence, without gaps).

    Sequences hold at most ``capacity`` tokens and are as full as the lengths allow. Null and empty texts are one end id;
    null ids, equal ids and repeated rows are packed row by row (among equal ones the places are interchangeable); an
    empty table gives an empty one. ``with_ids=False`` makes only the checksums of the ids.
    """
    stage = cut(tokenized(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids))
    return place(stage, capacity).withColumnRenamed("id", id_col)
