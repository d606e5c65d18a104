"""Spelling variants against plain Python over all pairs: awkward words, small sub-tries that are cut, long words, chains of forms."""

import collections
import random
import re
import zlib

from fleetspark.llm import spelling


def brute_words(docs):
    total = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(docs):
    vocab, near = brute_words(docs), collections.defaultdict(list)
    for a in vocab:
        for b in vocab:
            if abs(len(a) - len(b)) <= 1 and a != b and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-vocab[o], o))
        if vocab[best] >= 2 * vocab[w]:
            form[w] = best
    out = {}
    for w, n in vocab.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), vocab.get(form.get(w)))
    return out


def made(seed, words, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = []
        for _ in range(120):
            w = list(r.choice(words))
            for _ in range(r.choice([0, 0, 0, 1, 2])):
                k = r.randrange(len(w) + 1)
                kind = r.randrange(3)
                w[k:k + (kind > 0)] = r.choice("abcdeéÿ×") if kind < 2 else ""
            text.append("".join(w))
        rows.append((i, r.choice([" ", "\n", "-", "1"]).join(text)))
    return rows


def compare(frame, docs):
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame(docs)).collect()}
    want = brute([(r[0], r[1]) for r in docs])
    assert got == want
    return want


def test_variants_equal_all_pairs(frame):
    words = ["letter", "lettre", "better", "grouping", "gruoping", "anagram", "nagaram", "Maße", "aaaaaa", "ééééé", "house", "mouse"]
    want = compare(frame, made(1, words, 40))
    assert len(want) > 60 and any(r[0] for r in want.values()) and any(r[0] and r[0] != r[1] for r in want.values())


def test_small_sub_tries(frame, monkeypatch):
    """Deeper keys, sub-tries cut by the hash, small blocks: the same result (limits travel to the tasks with the functions)."""
    docs = made(2, ["abcde", "abcdf", "bacde", "edcba", "aabbcc", "abcabc", "cabbage"], 30)
    want = compare(frame, docs)
    vocab = frame(docs).sparkSession.createDataFrame([(w, r[2]) for w, r in want.items()], "word string, n long")
    monkeypatch.setattr(spelling, "SUB_TRIE", 7)
    got = {r["word"]: (r["n_near"], r["best"]["form"]) for r in spelling.neighbours(vocab).collect()}
    for w, r in want.items():
        assert got.get(w, (0, None))[0] == r[3]
        assert r[0] is None or got[w][1] == r[0]


def test_blocks_of_a_trie():
    words = sorted({"".join(random.Random(i).choices("abc", k=6)) for i in range(400)})
    trie = spelling.Trie(words, list(range(len(words))))
    for other in (words, sorted({w[:2] + w[3:] for w in words}), sorted({w + "c" for w in words})):
        q, w = trie.near(other)
        assert sorted((other[i], trie.words[j]) for i, j in zip(q, w)) == sorted((a, b) for a in other for b in words if one_edit(a, b))


def test_awkward_texts(frame, awkward):
    long = "q" * 40_000
    odd = [(100 + i, f"{long} {long}z Straße STRASSE naïve×naïve Ÿÿÿÿÿÿ ŠŠŠŠŠŠ 漢字漢字漢字 abc") for i in range(4)]
    docs = awkward + odd
    want = compare(frame, docs)
    assert any(len(w) > 39_000 and r[3] for w, r in want.items())
    assert spelling.variants(frame(docs).limit(0)).count() == 0


def test_chains_of_forms(frame):
    """Forms of forms: the root is the last."""
    words = {"aaaaa": 40, "aaaab": 20, "aaabb": 10, "aabbb": 5}
    docs = [(1, " ".join(w for w, n in words.items() for _ in range(n)))]
    want = compare(frame, docs)
    assert want["aabbb"][:2] == ("aaabb", "aaaaa")
