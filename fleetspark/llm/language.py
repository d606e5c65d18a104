"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import caches
from .frames import draw

#: Bytes read in one go (state starts anew), units a direction, windows computed together.
STEPS, UNITS, TOGETHER = 128, 8, 4096
#: The bounded sample that the network learns from: documents a label, windows a document.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS = 400, 4
EPOCHS, BATCH, RATE = 6, 128, 0.01
UNKNOWN = "und"


class Network:
    """Weights by name. Gates: z (keep), r (reset), n (new); h' = n + z (h - n), n = tanh(x + r (h U + c))."""

    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 0):
        g, self.labels, self.units = np.random.default_rng(seed), labels, units
        f32 = lambda *shape, scale: (g.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"out": f32(2 * units, len(labels), scale=0.2), "bias": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.w |= {f"{d}x": f32(256, 3 * units, scale=0.3), f"{d}u": f32(units, 3 * units, scale=units**-0.5), f"{d}c": np.zeros(units, np.float32)}

    def run(self, d: str, x: np.ndarray, keep: bool = False):
        """States (steps, windows, units) of one direction for bytes ``x`` (steps, windows); with ``keep`` also the gates."""
        n, wx, u, c = self.units, self.w[f"{d}x"], self.w[f"{d}u"], self.w[f"{d}c"]
        h = np.zeros((x.shape[1], n), np.float32)
        out, kept = np.empty((*x.shape, n), np.float32), []
        half = np.float32(0.5)
        for t in range(x.shape[0]):
            a, b = wx.take(x[t], axis=0), h @ u
            gates = a[:, :2 * n] + b[:, :2 * n]
            gates *= half
            np.tanh(gates, out=gates)
            gates += 1
            gates *= half
            z, r, inner = gates[:, :n], gates[:, n:], b[:, 2 * n:] + c
            new = np.tanh(a[:, 2 * n:] + r * inner)
            if keep:
                kept.append((h, z, r, inner, new))
            h = new + z * (h - new)
            out[t] = h
        return (out, kept) if keep else out

    def back(self, d: str, x: np.ndarray, kept: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time, given those of the states."""
        n, u = self.units, self.w[f"{d}u"]
        gx, gu, gc = (np.zeros_like(self.w[f"{d}{k}"]) for k in "xuc")
        carry = np.zeros_like(grad[0])
        for t in range(len(kept) - 1, -1, -1):
            h, z, r, inner, new = kept[t]
            g = grad[t] + carry
            dn = g * (1 - z) * (1 - new * new)
            dz = g * (h - new) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dx, dh = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dn * r], 1)
            np.add.at(gx, x[t], dx)
            gu += h.T @ dh
            gc += (dn * r).sum(0)
            carry = g * z + dh @ u.T
        return {f"{d}x": gx, f"{d}u": gu, f"{d}c": gc}

    @staticmethod
    def _turned(states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """States of the reversed windows put at the positions of the forward ones (and back)."""
        steps = states.shape[0]
        if (sizes == steps).all():
            return states[::-1]
        at = np.maximum(sizes[None, :] - 1 - np.arange(steps)[:, None], 0)
        return np.take_along_axis(states, at[:, :, None], 0)

    def positions(self, x: np.ndarray, back: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label probabilities (steps, windows, labels) of every position."""
        n = self.units
        y = self.run("f", x) @ self.w["out"][:n] + self._turned(self.run("b", back), sizes) @ self.w["out"][n:] + self.w["bias"]
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y

    def learn(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, seed: int = 0) -> None:
        """Adam on the cross-entropy of all positions; windows as (windows, steps), zero behind their size."""
        g, moments, step = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}, 0
        steps, n = x.shape[1], self.units
        for epoch in range(EPOCHS):
            order = g.permutation(len(x))
            for s in range(0, len(x), BATCH):
                at = order[s:s + BATCH]
                f, size = x[at].T, sizes[at]
                b = self._turned(f[:, :, None], size)[:, :, 0]
                (hf, kf), (hb, kb) = self.run("f", f, True), self.run("b", b, True)
                both = np.concatenate([hf, self._turned(hb, size)], 2)
                p = both @ self.w["out"] + self.w["bias"]
                p = np.exp(p - p.max(2, keepdims=True))
                p /= p.sum(2, keepdims=True)
                p[:, np.arange(len(at)), y[at]] -= 1
                p *= ((np.arange(steps)[:, None] < size[None, :]) / max(1, size.sum()))[:, :, None]
                p = p.astype(np.float32)
                down = p @ self.w["out"].T
                grads = {"out": np.einsum("tbi,tbk->ik", both, p, optimize=True), "bias": p.sum((0, 1))}
                grads |= self.back("f", f, kf, down[:, :, :n])
                turned = self._turned(down[:, :, n:], size) * (np.arange(steps)[:, None] < size[None, :])[:, :, None].astype(np.float32)
                grads |= self.back("b", b, kb, turned)
                step += 1
                norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in grads.values()))))
                rate = RATE * (1 - epoch / (EPOCHS + 1))
                for k, v in grads.items():
                    v /= norm
                    m = moments[k]
                    m[0] += 0.1 * (v - m[0])
                    m[1] += 0.01 * (v * v - m[1])
                    self.w[k] -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all positions of each document; documents lie in ``data`` between ``offsets``."""
        length = np.diff(offsets)
        count = -(-length // STEPS)
        doc = np.repeat(np.arange(len(length)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start, size = offsets[doc] + nth * STEPS, np.minimum(length[doc] - nth * STEPS, STEPS)
        total = np.zeros((len(length), len(self.labels)))
        order = np.argsort(-size, kind="stable")  # whole windows first, short ones together
        for s in range(0, len(order), TOGETHER):
            at = order[s:s + TOGETHER]
            b, n = start[at], size[at]
            steps = int(n[0])
            t = np.arange(steps)[:, None]
            x = data[np.minimum(b + t, len(data) - 1)]
            back = data[np.maximum(b + n - 1 - t, 0)]
            p = self.positions(x, back, n)
            if n[-1] < steps:
                p *= (t < n)[:, :, None]
            np.add.at(total, doc[at], p.sum(0, dtype=np.float64))
        return total / np.maximum(length, 1)[:, None]


def held_out(id_: Column) -> Column:
    """Documents that no label is learned from: crc32 of the id as text leaves 1 when divided by 3. Null ids are not."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = SAMPLE_DOCUMENTS,
          windows: int = SAMPLE_WINDOWS, seed: str = "language") -> Network | None:
    """A network for all labels that occur outside the held-out part, or None if there are none.

    It learns from at most ``documents`` texts a label (the first by a seeded hash of the id) and ``windows`` stretches of
    ``STEPS`` bytes from hashed places in each, so the driver's share is bounded whatever the table holds.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].cast("binary").alias("text"))
    usable = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    first = Window.partitionBy("lang").orderBy(draw(seed, F.col("id")), "id")
    chosen = usable.select("id", "lang").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= documents).select("id").distinct()
    size = F.octet_length("text")
    at = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda k: F.floor(draw(seed, F.col("id"), k) * F.greatest(size - STEPS + 1, F.lit(1))).cast("int"))
    cuts = usable.join(chosen, "id", "left_semi").filter(size > 0).select("id", "lang", F.explode(at).alias("at"), "text")
    found = cuts.select("lang", "id", "at", F.substring("text", F.col("at") + 1, F.lit(STEPS)).alias("part")).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["id"], r["at"]))
    labels = sorted({r["lang"] for r in found})
    x, sizes = np.zeros((len(found), STEPS), np.uint8), np.array([len(r["part"]) for r in found])
    for i, r in enumerate(found):
        x[i, :len(r["part"])] = np.frombuffer(r["part"], np.uint8)
    net = Network(labels)
    net.learn(x, sizes, np.array([labels.index(r["lang"]) for r in found]))
    return net


def identify(docs: DataFrame, network: Network | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``lang_pred`` and ``score``; columns of these names are replaced.

    Every position of the whole text is labelled, in windows of ``STEPS`` bytes; the document's probabilities are the mean. Null
    texts and texts without a letter get ``und`` with score 0, as does everything where there is no network. One row out for each
    row in, whatever repeats. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in ("lang_pred", "score")]
    letters = has_letters(docs[f"`{text_col}`"])
    work = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), F.when(letters, docs[f"`{text_col}`"].cast("binary")).alias("text"))
    model = spark.sparkContext.broadcast(network)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("language")
        net = model.value
        for batch in batches:
            text = batch.column(1)
            preds, scores = [UNKNOWN] * len(text), np.zeros(len(text))
            at = [i for i in range(len(text)) if text[i].is_valid and len(text[i].as_buffer())] if net else []
            for s in range(0, len(at), 500):
                part = text.take(pa.array(at[s:s + 500], pa.int64())).cast(pa.large_binary())
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + len(part) + 1]
                p = net.pooled(np.frombuffer(part.buffers()[2], np.uint8), offsets)
                best = p.argmax(1)
                for i, k in zip(at[s:s + 500], best.tolist()):
                    preds[i] = net.labels[k]
                scores[at[s:s + 500]] = np.clip(p[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds), pa.array(scores)], names=["row", "lang_pred", "score"])

    schema = StructType([StructField("row", work.schema["row"].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return work.mapInArrow(label, schema).select("row.*", "lang_pred", "score")
