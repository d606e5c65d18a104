"""The pipeline against a brute-force version: plain Python on the documents that the language stage keeps."""

import collections
import hashlib
import math
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from fleetspark.llm import language, mixing, secrets
from fleetspark.llm.queries import tokenizer_path

from .conftest import prose
from .test_minhash_repeats import brute_components

SF = "/root/testdata/sf0.001"


def redact(text):
    spans = sorted((s, e) for _, s, e in secrets.find(text, secrets.RULES))
    out, at = [], 0
    for s, e in spans:
        if e > at:
            out.append(text[at:max(s, at)] + ("[secret]" if s >= at else ""))
            at = e
    return "".join(out) + text[at:]


def mixed(docs, limit):
    tokens = {d: len((t or "").encode().split()) + 1 for d, t, _ in docs}
    sources = collections.defaultdict(list)
    for d, _, s in docs:
        sources[s].append(d)
    total = {s: sum(tokens[d] for d in ds) for s, ds in sources.items()}
    low, high = min(total.values()), max(total.values())
    e = 0.0 if high <= limit * low else 1 - math.log(limit) / math.log(high / low)
    uses = collections.Counter()
    for s, ds in sources.items():
        budget, block = round(total[s] ** e * high ** (1 - e)), 1
        while budget > 0:
            order = sorted((int(hashlib.md5(f"mix|{block}|{d}".encode()).hexdigest()[:13], 16), d) for d in ds)
            spent = 0
            for _, d in order:
                spent += tokens[d]
                if spent <= budget:
                    uses[d] += 1
            budget -= total[s]
            block += 1
    return uses


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = cp.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    labelled = language.identify(docs, language.train(docs)).collect()
    going = {r["doc_id"] for r in labelled if r["lang_pred"] == "und" or r["score"] < cp.LEAST_SCORE}
    rows = sorted((r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] not in going)
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in first.collect()) == rows
    keep = {r[0] for r in brute_components([(d, t) for d, t, _ in rows]) if r[3]}
    rows = [(d, redact(t), s) for d, t, s in rows if d in keep]
    uses = mixed(rows, cp.MAX_REPEATS)
    assert set(uses) == {r[0] for r in rows}
    coder, want = Tokenizer.from_file(tokenizer_path()), collections.Counter()
    for d, t, _ in rows:
        ids = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[(d, k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes()))] += uses[d]
    out = cp.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    assert len(by) <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_stages_on_awkward_rows(spark, frame, awkward):
    """Every stage but the last returns the columns of its documents, whatever they hold; clean documents stay."""
    docs = frame(awkward)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            assert stage(spark, docs.limit(0), SF).count() == 0
            docs = out
    ids = {r["doc_id"] for r in out.collect()}
    assert {4, 6, 7}.intersection(ids) and 7 in ids and None in ids


def test_language_stage_without_labels(spark, frame):
    """Nothing to learn from: documents with a letter stay."""
    docs = frame([(i, t, None, "a") for i, t in enumerate([prose(80, 40), prose(81, 40), "12 34", "", None])])
    assert sorted(r["doc_id"] for r in cp.keep_languages(spark, docs, SF).collect()) == [0, 1]


def test_language_stage_returns_the_documents_own_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.selectExpr("*", "doc_id * 2 AS score", "concat('x', doc_id) AS lang_pred")
    out = cp.keep_languages(spark, docs, SF).collect()
    assert out and all(r["score"] == 2 * r["doc_id"] and r["lang_pred"] == f"x{r['doc_id']}" for r in out)


def test_mixture_takes_effect_for_repeated_and_null_ids(spark, frame):
    """Uses of (id, source, tokens) are those that the mixture decided."""
    rows = [(i, prose(100 + i, 80), "en", "big") for i in range(12)] + [(50, prose(90, 10), "en", "big")] * 2
    rows += [(None, prose(130 + i, 20 + i), "en", "small") for i in range(7)] + [(50, prose(91, 9 + i), "en", "small") for i in range(4)]
    rows += [(60, prose(92, 8), "en", "small")] * 3 + [(None, prose(93, 8), "en", None)] * 5
    docs = frame(rows)
    want = collections.Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in mixing.mix(docs, max_repeats=cp.MAX_REPEATS).collect())
    out = cp.mix_sources(spark, docs, SF)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["source"], len(r["text"].split()) + 1) for r in out.collect())
    assert got == want and max(want.values()) > 1 and set(got) == {(r[0], r[3], len(r[1].split()) + 1) for r in rows}
