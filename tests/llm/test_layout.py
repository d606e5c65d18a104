"""Shards, mixtures and sequences: laws that must hold, on awkward rows and on the given tables."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import frames, mixing, packing, queries, shards
from fleetspark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


def test_ranks_inside_groups(spark):
    """Small cells: the same ranks and running sums as one window for each group."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), "id", (F.col("id") % 5).alias("w"))
    df = df.withColumn("u", frames.draw("t", F.col("id")))
    got = {r["id"]: (r["_rank"], r["_upto"], r["_size"]) for r in frames.rank_in_groups(df, "g", "u", ["id"], weight="w", cell_rows=20).collect()}
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[r["g"]].append((r["u"], r["id"], r["w"]))
    for rows in groups.values():
        total = 0
        for k, (_, i, w) in enumerate(sorted(rows)):
            total += w
            assert got[i] == (k, total, len(rows))


def test_shards_are_even_and_proportional(spark):
    rows = queries.QUERIES["op3_interleaved_shards"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by = collections.defaultdict(list)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
        by[r["shard"]].append(r)
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(8)) and max(sizes) - min(sizes) <= 1
    everywhere = collections.Counter(d["source"] for d in docs.values())
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        here = collections.Counter(docs[r["doc_id"]]["source"] for r in part)
        assert all(abs(here[s] - n / 8) < 2 for s, n in everywhere.items())


def test_shards_of_awkward_rows(frame, awkward, tmp_path):
    df = frame(awkward)
    out = shards.interleave(df, 4, carry={"text": df.text}).collect()
    assert len(out) == len(awkward) and sorted(r["position"] for r in out) == list(range(len(awkward)))
    assert sorted(collections.Counter(r["shard"] for r in out).values()) == [4, 4, 5, 5]
    assert shards.interleave(df.limit(0)).count() == 0
    assert {r["shard"] for r in shards.interleave(frame([(1, "x"), (2, "y")]), 8).collect()} == {0, 4}
    few = frame([(i, f"t{i}", "en", "a") for i in range(10)])
    shards.write_shards(few, shards.interleave(few, 3), str(tmp_path / "s"))
    back = few.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == 10 and {r["shard"] for r in back.select("shard").collect()} == {0, 1, 2}


def test_temperature(spark):
    sources = spark.createDataFrame([(10_000,), (1_000,), (100,)], "tokens long")
    e, budget = mixing.temperature(sources, max_repeats=4.0)
    assert e == pytest.approx(1 - np.log(4) / np.log(100), abs=1e-12)
    assert budget * 100**e / sum(t**e for t in (10_000, 1_000, 100)) == pytest.approx(400)
    e, _ = mixing.temperature(sources, target_entropy=0.9)
    w = np.array([10_000.0, 1_000, 100]) ** e
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9, abs=1e-9)
    e, budget = mixing.temperature(sources, max_repeats=3.0, budget=5_000)
    w = np.array([10_000.0, 1_000, 100]) ** e
    assert budget == 5_000 and max(budget * w / w.sum() / np.array([10_000, 1_000, 100])) == pytest.approx(3.0)
    assert mixing.temperature(sources, max_repeats=1.0, budget=10**9)[1] == 11_100
    assert mixing.temperature(sources.limit(0), max_repeats=2.0) == (1.0, 0.0)


def test_mixture_blocks(frame, awkward):
    df = frame(awkward + [(1000 + i, "w " * 9, "en", "big") for i in range(200)])
    out = mixing.mix(df, max_repeats=3.0).collect()
    uses = collections.defaultdict(list)
    for r in out:
        uses[(r["source"], r["block"])].append(r)
    every = collections.Counter(r["source"] for r in df.collect())
    for (source, block), rows in uses.items():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        if block <= int(rows[0]["blocks"] + 1e-9):
            assert len(rows) == every[source]
        else:
            assert sum(r["n_tokens"] for r in rows) <= rows[0]["blocks"] * sum(x["n_tokens"] for x in uses[(source, 1)]) + 1e-6
    assert {s for s, _ in uses} == set(every)
    assert max(r["blocks"] for r in out) <= 3.0 + 1e-9
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, max_repeats=None, target_entropy=1.2).count() > 0


def test_minimum_slack_fills_bins():
    r = np.random.default_rng(3)
    counts = collections.Counter(np.minimum(r.lognormal(4.5, 1.2, 5000).astype(int) + 1, 2048).tolist())
    bins = packing.minimum_slack(counts, 2048)
    used = collections.Counter()
    for times, lengths in bins:
        assert times > 0 and sum(n * k for n, k in lengths.items()) <= 2048
        for n, k in lengths.items():
            used[n] += times * k
    assert used == counts
    least = -(-sum(n * k for n, k in counts.items()) // 2048)
    assert sum(t for t, _ in bins) <= least + 1
    assert packing.minimum_slack({3: 5}, 10) == [(1, {3: 3}), (1, {3: 2})] and packing.minimum_slack({}, 10) == []


def check_packed(rows, texts, capacity):
    """Exact round trip through the tokenizer on whole texts; sequences without gaps or overlaps."""
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for d, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[(d, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packed_documents(spark):
    rows = queries.QUERIES["op6_packed_sequences"](spark, SF).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check_packed(rows, texts, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_awkward_rows(frame, awkward):
    odd = awkward + [(70, "it's 'sx <|endoftext|>x 12ab ÉCOLE İstanbul ΣΑΣ é a b   don't!! '' --- <|startoftext|>"), (71, "A\x85B\x1cC​D")]
    rows = packing.pack(frame(odd), tokenizer_path(), 64).collect()
    check_packed(rows, [(r[0], r[1]) for r in odd], 64)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    assert packing.pack(frame(odd).limit(0), tokenizer_path(), 64).count() == 0
