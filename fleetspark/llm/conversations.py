"""Conversation structure repair: cheapest edits to a legal turn order, found on a DAWG shared from the end by all conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import cut
from .frames import draw, text_mark

#: Costs of the edits; a truncated turn that stays costs extra.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
_FAULTS = ("blank", "duplicate", "truncated")
#: Grammar ``(s?(ua)+)?``: states 0 start, 1 after system, 2 after user, 3 after assistant; the next state by role initial.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role that an inserted or re-roled turn can take in each state.
_FREE = ("user", "user", "assistant", "user")
_INITIALS = "sua-"


def damage(conversations: DataFrame, key: Column) -> DataFrame:
    """Five kinds of damage by ``key`` % 20; dropped turns stay as rows with ``gone`` so that no conversation is lost. Nulls become one space."""
    k = key % 20
    text = F.coalesce("text", F.lit(" "))
    role = F.when(k == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    text = F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.array_repeat(k == 0, F.when(k == 3, 2).otherwise(1))).alias("gone")
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies)


def turn_key() -> Column:
    """Unsigned crc32 of ``conv_id:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary"))


def signatures(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal`` and ``signature``.

    The signature has one letter per turn, ``A`` + 4 * role (s, u, a, other) + fault (none, blank, duplicate, truncated). Turns
    are ordered by turn (nulls first), then role, then the text's hash. Only hashes of the texts are moved; tasks read a
    conversation turn by turn and keep one byte of each.
    """
    mark = text_mark(F.col("text"))
    rest = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = turns.select("conv_id", "turn", "role", "gone", mark.alias("mark"), (rest == "").alias("blank"),
                        F.coalesce(F.substring(rest, -1, 1), F.lit("")).isin(".", "!", "?").alias("closed")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "mark").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(F.col("blank"), 1).when(seen > 1, 2).when(~F.col("closed"), 3).otherwise(0)
    role = F.instr(F.lit(_INITIALS[:3]), F.substring("role", 1, 1))
    role = F.when((F.length("role") > 0) & (role > 0), role - 1).otherwise(3)
    code = F.when(F.col("gone"), -1).otherwise(role * 4 + fault)
    rows = rows.select("conv_id", "turn", "gone", "role", "mark", seen.alias("seen"), code.cast("int").alias("code"))
    rows = rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "mark", "seen")
    kind = turns.schema["conv_id"].dataType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, codes, turn, first, distinct = None, None, None, None, 0

        def done():
            faults = [sum(codes.count(4 * r + f) for r in range(4)) for f in (1, 2, 3)]
            illegal = sum(codes[i - 1] // 4 * 4 + codes[i] // 4 not in (1, 6, 9) for i in range(1, len(codes)))
            gaps = turn - first + 1 - distinct if distinct else 0
            return [at, gaps, *faults, illegal, "".join(chr(65 + c) for c in codes)]

        for batch in batches:
            out = []
            for conv, t, code in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if codes is None or conv != at:
                    if codes is not None:
                        out.append(done())
                    at, codes, turn, first, distinct = conv, bytearray(), None, None, 0
                if code >= 0:
                    codes.append(code)
                    if t is not None and t != turn:
                        first, turn, distinct = t if first is None else first, t, distinct + 1
            yield emit(out)
        if codes is not None:
            yield emit([done()])

    def emit(rows):
        cols = list(zip(*rows)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(kind)),
                                           *[pa.array(c, pa.int64()) for c in cols[1:6]], pa.array(cols[6], pa.string())],
                                          names=["conv_id", "gaps", *_FAULTS, "illegal", "signature"])

    return rows.select("conv_id", F.col("turn").cast("long"), "code").mapInArrow(read, f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


def _cheapest(options: list[tuple]) -> tuple | None:
    """Least cost; equal costs by the edit's letter. Each letter leads to one state, so this orders whole audits."""
    return min((o for o in options if o), key=lambda o: o[:2], default=None)


def _with_inserts(plain: list[tuple | None]) -> list[tuple | None]:
    """Cells (cost, letter, cell of the rest) of one node for the four states, an inserted turn first where that is cheaper."""
    best = plain
    for _ in range(4):
        after = [best[_NEXT[s][_FREE[s][0]]] for s in range(4)]
        best = [_cheapest([plain[s], after[s] and (after[s][0] + INSERT, "I", after[s])]) for s in range(4)]
    return best


END = _with_inserts([(0, "", None), None, None, (0, "", None)])


def node(letter: str, rest: list[tuple | None]) -> list[tuple | None]:
    """The automaton node of a turn's signature in front of the node ``rest``: cost-to-go and best audit for every grammar state."""
    role, fault = divmod(ord(letter) - 65, 4)
    extra = TRUNCATED if fault == 3 else 0
    cells = []
    for s in range(4):
        options = [rest[s] and (rest[s][0] + DELETE, "D", rest[s])]
        if fault not in (1, 2):
            kept = _NEXT[s].get(_INITIALS[role])
            if kept is not None and rest[kept]:
                options.append((rest[kept][0] + extra, "K", rest[kept]))
            free = rest[_NEXT[s][_FREE[s][0]]]
            options.append(free and (free[0] + REROLE + extra, "R", free))
        cells.append(_cheapest(options))
    return _with_inserts(cells)


def audits(found: DataFrame) -> DataFrame:
    """Adds ``cost`` and ``audit`` to rows with a ``signature``.

    Conversations are ranged by their signature read from the end, so those that share a suffix are neighbours. A task walks them in
    this order along the automaton: nodes of the suffix shared with the conversation before are there already, and an
    audit is a linked list that shares its tail with those before. Equal signatures are spread by a hash, so a hot one is no hot
    task; a node on the border of two ranges is made by both.
    """
    columns, kind = found.columns, found.schema
    rows = found.withColumn("_back", F.reverse("signature")).withColumn("_spread", draw("audit", F.col("conv_id")))
    rows = rows.repartitionByRange("_back", "_spread").sortWithinPartitions("_back")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", cost long, audit string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, nodes, audit = "", [END], ""
        for batch in batches:
            costs, texts = [], []
            for back in batch.column("_back").to_pylist():
                if back != before:
                    shared = next((i for i, (a, b) in enumerate(zip(back, before)) if a != b), min(len(back), len(before)))
                    del nodes[shared + 1:]
                    for letter in back[shared:]:
                        nodes.append(node(letter, nodes[-1]))
                    letters, cell = [], nodes[-1][0]
                    while cell:
                        letters.append(cell[1])
                        cell = cell[2]
                    before, audit = back, "".join(letters)
                costs.append(nodes[-1][0][0]), texts.append(audit)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(costs, pa.int64()), pa.array(texts, pa.string())], names=[*columns, "cost", "audit"])

    return rows.select(*columns, "_back").mapInArrow(walk, schema)


def _in_order(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """Each conversation's audit row, then its turns in order, in one partition."""
    info = F.struct(*[F.col(c) for c in audit.columns])
    head = audit.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), info.alias("info"))
    body = turns.filter("NOT gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text").withColumn("info", F.lit(None).cast(head.schema["info"].dataType))
    rows = head.unionByName(body).withColumn("mark", text_mark(F.col("text"))).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "mark")
    return rows.select("kind", "role", "text", "info")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(header, None, None) at the start of each conversation, then (header, role, text) for each turn of its repaired form."""
    info, rest, state = None, iter(()), 0

    def inserts(rest):
        nonlocal state
        for letter in rest:
            if letter != "I":
                return letter
            role, state = _FREE[state], _NEXT[state][_FREE[state][0]]
            made.append((info, role, ""))
        return None

    for batch in batches:
        for kind, role, text, header in zip(*(batch.column(i).to_pylist() for i in range(4))):
            made = []
            if kind == 0:
                if info is not None:
                    inserts(rest)
                    yield from made
                info, rest, state = header, iter(header["audit"]), 0
                yield info, None, None
                continue
            letter = inserts(rest)
            if letter != "D":
                role = role if letter == "K" else _FREE[state]
                state = _NEXT[state][role[0]]
                made.append((info, role, text))
            yield from made
    if info is not None:
        made = []
        inserts(rest)
        yield from made


def repaired(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text."""
    rows = _in_order(turns, audit)
    kind = turns.schema["conv_id"].dataType

    def run(batches):
        ids, places, roles, texts, size, place = [], [], [], [], 0, 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())],
                                              names=["conv_id", "position", "role", "text"])
        for info, role, text in _edited(batches):
            if role is None:
                place = 0
                continue
            ids.append(info["conv_id"]), places.append(place), roles.append(role), texts.append(text)
            place, size = place + 1, size + len(text) + 64
            if size > 1 << 22:
                yield batch()
                ids, places, roles, texts, size = [], [], [], [], 0
        yield batch()

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, position long, role string, text string")


def digests(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """The columns of ``audit`` and ``repaired_sha256``: the hash of the repaired ``role:text``, joined by newlines.

    The hash is fed turn by turn, so a task holds one batch of texts and one audit, however long a conversation is.
    """
    rows = _in_order(turns, audit)
    kind = audit.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", repaired_sha256 string"

    def run(batches):
        heads, sums, info, sha, more = [], [], None, None, False

        def batch():
            at = pa.array(heads, pa.struct(types)).flatten() if heads else [pa.array([], t.type) for t in types]
            return pa.RecordBatch.from_arrays([*at, pa.array(sums, pa.string())], names=[*[t.name for t in types], "repaired_sha256"])

        types = None

        def typed(batches):
            nonlocal types
            for b in batches:
                types = list(b.schema.field("info").type)
                yield b

        for header, role, text in _edited(typed(batches)):
            if role is None:
                if info is not None:
                    heads.append(info), sums.append(sha.hexdigest())
                    if len(heads) >= 4096:
                        yield batch()
                        heads, sums = [], []
                info, sha, more = header, hashlib.sha256(), False
                continue
            sha.update((("\n" if more else "") + role + ":" + text).encode())
            more = True
        if info is not None:
            heads.append(info), sums.append(sha.hexdigest())
            yield batch()

    return rows.mapInArrow(run, schema)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text, gone): counts of its faults, the least cost and its audit.

    Faults, first that holds: blank, duplicate (role and text seen earlier), truncated (does not end in ``.!?``). Edits: Keep 0, Rerole 3,
    Delete 4 (a must for blank and duplicate), Insert 3; a truncated turn that stays costs 3 more. The audit is the cheapest edits' initials
    in order, ties ASCII-least. Null ids are one conversation; rows with ``gone`` only name it; equal turns are ordered by role and text hash;
    an empty role or one with another initial is never legal. A conversation without turns costs nothing. Extra columns are ignored.
    """
    return audits(cut(signatures(turns)))
