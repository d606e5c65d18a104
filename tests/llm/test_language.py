"""The network learns (finite-difference gradients, held-out accuracy) and pools whole texts."""

import numpy as np
from pyspark.sql import functions as F

from fleetspark.llm import language

SF = "/root/testdata/sf0.01"


def test_gradients():
    """Backpropagation through time against finite differences, short windows included."""
    g = np.random.default_rng(1)
    net = language.Network(["a", "b", "c"], units=3, seed=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, sizes, y = g.integers(1, 5, (4, 6)).astype(np.uint8), np.array([6, 4, 6, 1]), np.array([0, 1, 2, 1])
    x[np.arange(6)[None, :] >= sizes[:, None]] = 0
    mask = (np.arange(6)[:, None] < sizes[None, :])

    def loss():
        f = x.T
        b = net._turned(f[:, :, None], sizes)[:, :, 0]
        p = net.positions(f, b, sizes)
        return -(np.log(p[:, np.arange(4), y]) * mask).sum() / sizes.sum()

    seen = {}
    old = language.EPOCHS, language.RATE
    language.EPOCHS, language.RATE = 1, 0.0
    try:
        real = language.Network.back

        def spy(self, d, *a):
            out = real(self, d, *a)
            seen.update({k: v.copy() for k, v in out.items()})
            return out
        language.Network.back = spy
        net.learn(x, sizes, y)
    finally:
        language.Network.back = real
        language.EPOCHS, language.RATE = old
    for name in ("fx", "bu", "bc", "fu", "bx"):
        flat = net.w[name].reshape(-1)
        for i in g.choice(len(flat), 6) if name[1] != "x" else [int(b) * 9 + 4 for b in (1, 2, 3, 4)]:
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-3 - seen[name].reshape(-1)[i]) < 2e-3


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.identify(d, language.train(d)).withColumn("held", language.held_out(F.col("doc_id")))
    assert out.count() == d.count()
    row = out.filter("held AND lang IS NOT NULL AND length(text) > 40").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()
    assert row[0] > 0.98


def test_pooling_is_the_mean_over_positions():
    net = language.Network(["a", "b"], seed=3)
    texts = [b"abc", b"", b"x" * 300, bytes(range(97, 120)) * 20, b"q"]
    offsets = np.cumsum([0, *map(len, texts)])
    p = net.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, got in zip(texts, p):
        total = np.zeros(2)
        for s in range(0, len(t), language.STEPS):
            x = np.frombuffer(t[s:s + language.STEPS], np.uint8)[:, None]
            total += net.positions(x, x[::-1], np.array([len(x)])).sum((0, 1))
        assert np.allclose(got, total / max(1, len(t)), atol=1e-5)


def test_awkward_rows(frame, awkward):
    df = frame(awkward)
    out = language.identify(df, language.train(df))
    assert out.columns == [c for c in df.columns if c != "score"] + ["lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == len(awkward)
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in {"en", "de", "fr", "xx"} and 0 < r["score"] <= 1
    assert language.train(frame([(1, "text", None)])) is None
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}
    assert language.identify(df.limit(0), None).count() == 0
