"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from . import caches
from .components import components
from .frames import row_hash, text_mark

SHINGLE = 5
#: Collections of sub-keys: ``LEFT`` of three minima each, ``RIGHT`` of two; a table key is a pair of one of each.
LEFT, RIGHT = 22, 14
MINIMA = 3 * LEFT + 2 * RIGHT
#: Minima of which a byte is kept to judge pairs, and how many bytes must agree; a likeness of 0.75 fails with odds below 1e-9.
SKETCH, AGREE = 60, 22
#: Ids up to this many are sent to all tasks instead of moving the texts to them.
FEW_IDS = 100_000

_U = np.uint64
_RNG = np.random.default_rng(20240501)
_FACTOR = _RNG.integers(1, 2**63, MINIMA, dtype=_U)[:, None] * _U(2) + _U(1)
_SHIFT = _RNG.integers(0, 2**63, MINIMA, dtype=_U)[:, None]
_ROLL = _RNG.integers(1, 2**63, SHINGLE, dtype=_U) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[bytes | None]) -> list[np.ndarray]:
    """The set of 64-bit shingle hashes of each text, ascending.

    A-Z become lower case; words are separated by space and the control characters 9 to 13, which is what ``bytes.split`` does.
    """
    words = [(t or b"").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(caches.WORDS.__getitem__, (w for ws in words for w in ws)), _U, int(counts.sum()))
    rolled = np.zeros(0, _U)
    if len(flat) >= SHINGLE:
        n = len(flat) - SHINGLE + 1
        rolled = flat[:n] * _ROLL[0]
        for k in range(1, SHINGLE):
            rolled = rolled + flat[k:n + k] * _ROLL[k]
        rolled = _mix(rolled)
    out, at = [], 0
    for m in counts.tolist():
        if m >= SHINGLE:
            out.append(np.unique(rolled[at:at + m - SHINGLE + 1]))
        elif m:
            h = np.array([m], _U)
            for x in flat[at:at + m]:
                h = _mix(h * _ROLL[0] + _ROLL[1:2] * x)
            out.append(h)
        else:
            out.append(rolled[:0])
        at += m
    return out


def _print(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return np.array([s.sum(dtype=_U), _mix(s ^ _U(0x9E3779B97F4A7C15)).sum(dtype=_U)], _U).tobytes()


def _minima(s: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, np.iinfo(np.uint64).max, _U)
    for at in range(0, len(s), 4096):
        np.minimum(low, (s[at:at + 4096] * _FACTOR + _SHIFT).min(axis=1), out=low)
    return low


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), part.column(1).to_pylist()


def _subkeys(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the left collection, 32-bit ones of the right one."""
    def joined(x: np.ndarray) -> np.ndarray:
        h = np.arange(len(x)).astype(_U)
        for column in x.T:
            h = _mix(h * _ROLL[0] + column)
        return h
    left, rest = low[:3 * LEFT].reshape(-1, 3), low[3 * LEFT:].reshape(-1, 2)
    return joined(left).view(np.int64), (joined(rest) >> _U(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n`` (set size), ``print`` (16 bytes of the set), and for sets that are not empty ``left`` and ``fine`` (sub-keys) and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("words")
        for ids, texts in _texts(batches):
            sets = shingles(texts)
            left, fine, sketch = [], [], []
            for s in sets:
                low = _minima(s) if len(s) else None
                keys = _subkeys(low) if len(s) else (None, None)
                left.append(keys[0]), fine.append(keys[1])
                sketch.append((_mix(low[:SKETCH]) >> _U(56)).astype(np.uint8).view(np.int8) if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.binary()), pa.array(left, pa.list_(pa.int64())),
                                              pa.array(fine, pa.list_(pa.int32())), pa.array(sketch, pa.list_(pa.int8()))], names=["id", "n", "print", "left", "fine", "sketch"])

    cols = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    return cols.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, print binary, left array<long>, fine array<int>, sketch array<tinyint>")


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("words")
        for _, texts in _texts(batches):
            sets = shingles(texts)
            yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                             names=["print", "set"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, "print binary, set array<long>")


def _scatter(c: Column) -> Column:
    """A one-to-one map of numbers to numbers in no order."""
    c = c.bitwiseXOR(F.shiftleft(c, 13))
    c = c.bitwiseXOR(F.shiftrightunsigned(c, 7))
    return c.bitwiseXOR(F.shiftleft(c, 17))


def _tables(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node) of the tables: each left sub-key (``key``) with each right sub-key."""
    subs = F.array(*[F.xxhash64(F.col("key"), F.lit(i), F.get("fine", F.lit(i))) for i in range(RIGHT)])
    return rows.join(classes.select("node", "fine"), "node").select(F.explode(subs).alias("key"), "node")


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, node, root) of the keys under which classes of different components meet."""
    placed = met.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    return placed.join(open_, "key")


def _sharing_rare(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of different components that could be linked, without forming the pairs of a group.

    Sets that share three quarters of either share one of the rarest shingles of both: of n, the first n - ceil(3 n / 4) + 1 in the
    order of how many of ``sets`` hold them. Heavily edited copies have only their own edits among these. Under each shingle the
    component with most sets is not joined with itself.
    """
    rows = sets.select("node", F.size("set").alias("n"), F.explode("set").alias("s"))
    held = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("node").orderBy("df", "s")
    rare = rows.join(held, "s").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * 0.75) + 1).filter("df > 1")
    rare = cut(rare.select("s", "node", "n", "r").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    most = rare.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    fewer = rare.join(most, "s").filter("root <> main").select("s", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("r").alias("rr"))
    # linked sets of these sizes share so many; both then have a common one among their first n - needed + 1
    needed = F.ceil((F.col("n") + F.col("nx")) * 3 / 7)
    pairs = fewer.join(rare, "s").filter((F.col("rx") != F.col("root")) & (F.col("r") <= F.col("n") - needed + 1) & (F.col("rr") <= F.col("nx") - needed + 1))
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _stars(met: DataFrame) -> DataFrame:
    """Pairs of each class with the pivot of each of its keys, sizes permitting.

    The pivot of a key is the class whose keys are shared most: among edited copies the one with the fewest edits, to which all that
    can be linked at all are close.
    """
    weight = met.groupBy("node").agg(F.sum("c").alias("w"))
    rows = met.join(weight, "node")
    pivots = rows.groupBy("key").agg(F.max(F.struct("w", "node", "n")).alias("p"))
    close = (F.col("node") != F.col("p.node")) & (4 * F.least("n", "p.n") >= 3 * F.greatest("n", "p.n"))
    return rows.join(pivots, "key").filter(close).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and minima allow a likeness of 0.75."""
    sides = [classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"k{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    same = F.size(F.filter(F.zip_with("ka", "kb", lambda x, y: x == y), lambda t: t))
    return both.filter((4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb")) & (same >= AGREE)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    sides = [sets.select(F.col("node").alias(s), F.col("set").alias(f"s{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    met = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * met >= 75 * (F.size("sa") + F.size("sb") - met)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked when 100 * |A and B| >= 75 * |A or B| for their sets of distinct five-word shingles (the whole
    sequence where there are fewer words); ``component_id`` is the smallest id reachable and ``kept`` says that it is the own.

    Equal sets are one class from the start. Each class computes two collections of sub-keys, 22 of three minima and 14 of two, whose
    pairs are the keys of 308 tables: 94 minima where separate bands of five would take 1,540. A link at 0.75 meets in no table with
    odds of 2e-5. Left sub-keys that one class alone has are dropped, as no table of theirs is shared. Under each other one, all
    classes are compared with the most shared one. Only where classes of different components are then left, the
    tables are formed; the classes that meet there across components are compared if they share a rare shingle, which
    linked ones must. So a group of thousands of copies gives a few comparisons for each, never all pairs. Every link is
    confirmed on full sets, made from the whole texts of those classes only that have a plausible partner.

    Null or empty texts have an empty set, are linked with nothing and kept. Null ids take part: a component's id is the smallest
    non-null one. Rows with equal ids are separate documents with the same id. An empty table gives an empty one.
    """
    rows = cut(signatures(docs, id_col, text_col))
    kept = [F.any_value(c).alias(c) for c in ("n", "left", "fine", "sketch")]
    classes = rows.filter("n > 0").groupBy("print").agg(F.min("id").alias("id"), *kept)
    classes = cut(classes.withColumn("node", _scatter(F.monotonically_increasing_id())))
    keyed = classes.select(F.explode("left").alias("key"), "node", "n")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y").select("key", "c")
    met = cut(keyed.join(shared, "key"))
    stars = cut(_plausible(_stars(met), classes))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = cut(classes.join(nodes, "node").select("node", "print", "id"))
        ids = wanted.select(F.col("id").alias("_id")).distinct()
        ids = F.broadcast(ids) if wanted.count() <= FEW_IDS else ids
        texts = docs.join(ids, docs[id_col].eqNullSafe(F.col("_id")), "left_semi")
        made = _sets(texts, id_col, text_col).dropDuplicates(["print"])
        return cut(made.join(wanted.select("node", "print"), "print").select("node", "set"))

    links = cut(_confirmed(stars, sets_of(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct())))
    roots = components(links)
    left = _apart(met, roots)
    tables = cut(_apart(_tables(left, classes), roots).select("node").distinct())
    if not tables.isEmpty():
        sets = sets_of(tables)
        rest = cut(_plausible(_sharing_rare(sets, roots), classes).join(stars, ["a", "b"], "left_anti"))
        links = links.unionByName(_confirmed(rest, sets))
        roots = components(links)
    named = classes.select("print", "id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(lowest, "root").select("print", "component_id")
    out = rows.join(named, "print", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, with all its columns: the smallest id, null ids last.

    Rows of that id in one component are told apart by a hash of the text, then of the other columns; rows equal in all of them
    are interchangeable. Rows with an empty set are linked with nothing, so all of them stay.
    """
    key = F.struct(docs[f"`{id_col}`"].isNull().alias("none"), docs[f"`{id_col}`"].alias("id"), text_mark(docs[f"`{text_col}`"]).alias("mark"))
    verdicts = near_duplicates(docs.select(key.alias("_key"), docs[f"`{text_col}`"].alias("_text")), "_key", "_text")
    copies = (F.max("n_shingles") > 0) & (F.count(F.lit(1)) > 1)
    kept = cut(verdicts.filter("kept").groupBy(F.col("_key").alias("_kept")).agg(copies.alias("_copies")))
    out = docs.join(kept.filter("NOT _copies"), key == F.col("_kept"), "left_semi")
    copied = kept.filter("_copies").select("_kept")
    count = copied.count()
    if count:
        copied = F.broadcast(copied) if count <= FEW_IDS else copied
        columns = [docs[f"`{c}`"] for c in docs.columns]
        first = docs.join(copied, key == F.col("_kept")).groupBy("_kept").agg(F.min_by(F.struct(*columns), row_hash(docs)).alias("_row"))
        out = out.unionByName(first.select("_row.*"))
    return out
