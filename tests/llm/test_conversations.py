"""Conversation repair against plain Python: every edit sequence by shortest path, awkward turns, the repaired rows themselves."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fleetspark.llm import conversations as c
from fleetspark.llm import queries

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def brute(rows):
    """Rows (role, text) in order: counts, cost, audit, repaired rows; Dijkstra over (rows read, state) with the audit as tie-break."""
    faults, seen = [], set()
    for role, text in rows:
        rest = text.rstrip(SPACE)
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        for ini, name in (("u", "user"), ("a", "assistant")):
            if ini in NEXT[state] and len(out) < 3 * len(rows) + 3:
                heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state][ini], (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state][role[:1]], (*out, (role, text))))
                for ini, name in (("u", "user"), ("a", "assistant")):
                    if ini in NEXT[state]:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, NEXT[state][ini], (*out, (name, text))))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return [*[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, out]


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")
    for name in ("mark", "seen", "code", "kind", "info", "audit", "cost", "signature", "position"):
        df = df.withColumn(name, F.lit(7))
    return df


def check(spark, rows):
    turns = turns_of(spark, rows)
    found = c.repair(turns)
    got = {r["conv_id"]: r for r in c.digests(turns, found).collect()}
    fixed = {}
    for r in sorted(c.repaired(turns, found).collect(), key=lambda r: r["position"]):
        fixed.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        mine = [r for r in rows if r[0] == conv and not r[4]]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        *counts, cost, audit, out = brute([(r[2], r[3]) for r in mine])
        at = [r[1] for r in mine if r[1] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        assert [row[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")] == [gaps, *counts, cost, audit], (conv, mine)
        assert fixed.get(conv, []) == list(out)
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_repairs_equal_all_edits_tried(spark):
    r = random.Random(5)
    texts = ["Yes.", "No!", "Why? ", "cut off", "and", "", " \n", "Fine.\t"]
    rows = [(conv, r.choice([t, t, t + 3, None]), r.choice(["user", "assistant", "assistant", "system", "tool", ""]), r.choice(texts), False)
            for conv in range(150) for t in range(r.randrange(1, 9))]
    check(spark, rows)


def test_awkward_turns(spark):
    long = "word " * 200_000 + "end."
    rows = [(None, None, "user", "Hi.", False), (None, None, "user", "Hi.", False), (None, 4, "assistant", "Yo.", False), (1, None, " ", " ", False), (2, 0, "user", "gone", True),
            (3, 7, "assistant", long, False), (3, -2, "user", long + "?", False), (4, 1, "user", "Ä ", False), (4, 1, "assistant", "漢字\U0001f600!", False)]
    rows += [(5, i, ("user", "assistant")[i % 2], f"Line {i}.", False) for i in range(3001)]
    check(spark, rows)
    assert c.repair(turns_of(spark, rows).limit(0)).count() == 0
    empty = c.repair(turns_of(spark, [(2, 0, "user", "x", True)])).collect()[0]
    assert (empty["cost"], empty["audit"], empty["gaps"]) == (0, "", 0)


def test_damage(spark):
    """All kinds of damage, on the given table, by the rule."""
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = rows.unionByName(spark.createDataFrame([(None, None, None, None), (900, None, "user", None)], rows.schema))
    want = []
    for r in rows.collect():
        key = ":".join(" " if v is None else str(v) for v in (r["conv_id"], r["turn"]))
        k = zlib.crc32(key.encode()) % 20
        role, text = ("user" if k == 4 else r["role"] or " "), r["text"] if r["text"] is not None else " "
        text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
        want += [(r["conv_id"], r["turn"], role, text, k == 0)] * (2 if k == 3 else 1)
    got = [tuple(r) for r in c.damage(rows, c.turn_key()).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_shared_suffixes_share_nodes(spark, monkeypatch):
    """A suffix that conversations share is one run of nodes: 400 conversations with one ending make few of them in a task."""
    rows = [("I" if i % 3 else "") + "AEI" * (i % 5) + "EI" * 6 for i in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "conv_id long, signature string").coalesce(1)
    out = {r["conv_id"]: r for r in c.audits(df).collect()}
    assert all(out[i]["cost"] >= 0 and len(out[i]["audit"].replace("I", "")) == len(s) for i, s in enumerate(rows))
    assert len({(out[i]["cost"], out[i]["audit"]) for i in range(400)}) == len(set(rows))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_on_the_whole_table(spark, sf):
    turns = c.damage(spark.read.parquet(f"{sf}/conversations.parquet"), c.turn_key()).collect()
    got = {r["conv_id"]: r for r in queries.QUERIES["op12_dawg_conversation_repair"](spark, sf).collect()}
    assert set(got) == {r["conv_id"] for r in turns}
    for conv, row in got.items():
        mine = sorted((r for r in turns if r["conv_id"] == conv and not r["gone"]), key=lambda r: r["turn"])
        *counts, cost, audit, out = brute([(r["role"], r["text"]) for r in mine])
        assert [row[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")] == [*counts, cost, audit]
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
