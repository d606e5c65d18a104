"""Near-duplicates and repeated strings against brute force on hand-made and given documents."""

import collections
import random

import pytest

from fleetspark.llm import components, minhash, repeats

from .conftest import prose


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            met = len(sets[i] & sets[j])
            if met and 100 * met >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d, d == (low.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def edited(text, seed, share):
    r, w = random.Random(seed), text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_components_against_brute_force(frame, awkward):
    rows = list(awkward)
    base = prose(50, 150)
    rows += [(100 + i, edited(base, i, 0.004 * (i % 14))) for i in range(60)]
    rows += [(200 + i, prose(60, 40) + " " + prose(300 + i, 60)) for i in range(40)]
    got = minhash.near_duplicates(frame(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components([(r[0], r[1]) for r in rows])


def test_copies_that_no_star_links(frame):
    """Two families and heavy edits: links between copies of which neither is close to the smallest one."""
    rows = [(i, edited(prose(51, 120), i, 0.01 * (i % 7))) for i in range(60)] + [(100 + i, edited(prose(52, 120), i % 10, 0.05)) for i in range(40)]
    rows += [(200 + i, edited(edited(prose(51, 120), 900 + i // 3, 0.08), i, 0.005)) for i in range(60)]
    got = minhash.near_duplicates(frame(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components([(r[0], r[1]) for r in rows])


def test_kept_documents_keep_their_columns(frame):
    df = frame([(1, prose(7, 50), "en", "a"), (2, prose(7, 50) + " more", "en", "b"), (3, None, None, None)])
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_one_row_of_each_component_stays(frame):
    """Repeated rows, an id with several texts and null ids beside an empty text."""
    near, other, lone = prose(70, 60), prose(71, 60), prose(72, 60)
    rows = [(1, other, "en", "a")] * 4 + [(3, near, "en", "a"), (7, near + " tail", "en", "a"), (7, lone, "en", "b")]
    rows += [(9, prose(73, 60), "en", s) for s in "cab"] + [(8, prose(74, 60), "en", "a"), (8, prose(74, 60) + " tail", "en", "a")]
    rows += [(None, near, None, "a"), (None, prose(75, 60), None, "a"), (None, prose(75, 60), None, "a"), (None, prose(75, 60) + " x", None, "a")]
    rows += [(None, None, None, None), (None, "", None, None), (None, "", None, None), (2, " ", "en", "a"), (2, " ", "en", "a")]
    df = frame(rows)
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    first = lambda *texts: sum(got.count((d, t)) for d, t in texts)
    assert [got.count(x) for x in ((1, other), (3, near), (7, near + " tail"), (7, lone), (9, prose(73, 60)), (None, near))] == [1, 1, 0, 1, 1, 0]
    assert first((8, prose(74, 60)), (8, prose(74, 60) + " tail")) == 1 and first((None, prose(75, 60)), (None, prose(75, 60) + " x")) == 1
    assert (got.count((None, None)), got.count((None, "")), got.count((2, " ")), len(got)) == (1, 2, 2, 11)
    again = minhash.drop_near_duplicates(df.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out.collect()))


def test_no_documents(frame, spark):
    assert minhash.near_duplicates(frame([(1, "x")]).limit(0)).count() == 0
    assert repeats.remove_repeats(frame([(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 300])
def test_a_path_is_one_component(spark, n):
    r = random.Random(3)
    nodes = r.sample(range(-10**9, 10**9), n)
    edges = [(a, b) for a, b in zip(nodes, nodes[1:])] + [(10**10, 10**10 + 1)]
    out = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == n + 2 and len({x["root"] for x in out}) == 2 and {x["root"] for x in out} <= {x["node"] for x in out}


def brute_repeats(rows, length):
    order = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in order:
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for (d, _), (o, t) in zip(rows, order):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < o:
                gone[p:p + length] = b"\1" * length
        spans, p = [], 0
        while p < len(t):
            q = p
            while q < len(t) and gone[q]:
                q += 1
            if q > p:
                spans.append((p, q))
            p = max(q, p + 1)
        out.append((d, len(t), tuple(spans), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def taken(df, length, **more):
    return sorted(((r[0], r[1], tuple((s["start"], s["end"]) for s in r[2]), bytes(r[3])) for r in repeats.remove_repeats(df, length, **more).collect()), key=repr)


def test_repeats_against_brute_force(frame, awkward):
    shared = prose(8, 12)
    rows = [r for r in awkward if r[1] is None or len(r[1]) < 60_000]
    rows += [(100 + i, prose(400 + i, 20) + shared[:30 + 2 * i] + prose(500 + i, 20) + shared[20:]) for i in range(30)]
    assert taken(frame(rows), 50) == brute_repeats([(r[0], r[1]) for r in rows], 50)


def test_repeats_in_long_texts_and_small_portions(frame, awkward, monkeypatch):
    """Chunks, batches and portions cut the work but not the result."""
    for name, value in (("CHUNK", 1000), ("SYMBOLS", 2000), ("BATCH_BYTES", 5000)):
        monkeypatch.setattr(repeats, name, value)
    rows = [r for r in awkward if r[1] is None or len(r[1]) < 300] + [(50, prose(9, 1500)), (51, prose(9, 1500)[2000:5000]), (52, "ab" * 700), (53, "ab" * 900)]
    assert taken(frame(rows), 30, gram=12) == brute_repeats([(r[0], r[1]) for r in rows], 30)


def test_breaks_equal_compared_prefixes():
    import numpy as np
    r = random.Random(5)
    for _ in range(30):
        text = np.array([r.choice([0, 1, 2, 3, 3]) for _ in range(200)] + [0], np.int16)
        order = repeats.suffix_order(text, 9)
        breaks = repeats.common_prefix_breaks(text, order, 9)
        words = [tuple(text[i:i + 9]) for i in order]
        whole = [len(w) == 9 and 0 not in w for w in words]
        groups = np.cumsum(breaks)
        named = collections.defaultdict(set)
        for w, ok, g in zip(words, whole, groups):
            if ok:
                named[g].add(w)
        assert all(len(v) == 1 for v in named.values()) and len(named) == len({w for w, ok in zip(words, whole) if ok})
