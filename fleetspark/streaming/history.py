"""What is known of arrived labels at each request: own and other stage, same life, same wafer; kept in keyed lists and maps.

A micro-batch reads and writes only what its rows touch: two decayed summaries, the labels of the last day, the lives it names and the
blocks of neighbouring wafers it names. Event-time timers take out lives and wafers that nothing can ask for any more.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import as_timestamp
from .processors import DAY, HOUR, PART, STORE, forget, frame

RUN, OWN, OTHER = 1, 0, 2  # kinds of rows: a request, a label of the same stage, a label of the other stage
HALF_LIVES = {"e05": 0.5, "e2": 2.0, "e8": 8.0, "e24": 24.0}
LEAST_WEIGHT = 1e-3  # a decayed mean of less weight is null
LAST = 10
BLOCK = 1024  # neighbouring wafers that share an entry of the state
WAFER = np.dtype([("wafer", "<i8"), ("y", "<f8"), ("t", "<f8"), ("at", "<f8")])


class ArrivedHistory(StatefulProcessor):
    """Features of a request from the labels that arrived strictly before it.

    Input rows: run_id, wafer, life, kind, at (request or arrival time), t (process end), y. Decayed means go by process time; a wafer's
    other label counts if it arrived at most ``wait`` seconds before the request. A life silent for longer than ``wait`` is forgotten, so
    ``wait`` must cover a life. Labels without a value are ignored; requests without a life or a wafer get nulls there.
    """

    schema = ("scenario string, regime string, run_id long, at double, n long, mean double, last1 double, mean3 double, mean10 double, n24 long, age_h double, "
              + "".join(f"{k} double, " for k in HALF_LIVES) + "x_n long, " + "".join(f"x_{k} double, " for k in HALF_LIVES)
              + "life_n long, life_mean double, partner_y double, partner_lag_h double")

    def __init__(self, wait: float):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sides = handle.getMapState("sides", "kind int", "n long, total double, top double, weight array<double>, sum array<double>")
        self.recent = handle.getListState("recent", "t double, y double")
        self.lives = handle.getMapState("lives", "life long", "n long, total double, at double")
        self.wafers = handle.getMapState("wafers", "block long", "labels binary")  # rows of WAFER, one a wafer
        self.cleared: dict[tuple, int] = {}

    def _learn(self, s: list, t: float, y: float) -> list:
        n, total, top, weight, sums = s
        fade = [0.5 ** (abs(t - top) / HOUR / h) for h in HALF_LIVES.values()] if n else [0.0] * len(HALF_LIVES)
        if n and t < top:
            return [n + 1, total + y, top, [w + f for w, f in zip(weight, fade)], [v + y * f for v, f in zip(sums, fade)]]
        return [n + 1, total + y, t, [w * f + 1.0 for w, f in zip(weight, fade)], [v * f + y for v, f in zip(sums, fade)]]

    def _decayed(self, s: list, at: float, lead: str) -> dict:
        n, _, top, weight, sums = s
        left = [w * 0.5 ** ((at - top) / HOUR / h) if n else 0.0 for w, h in zip(weight, HALF_LIVES.values())]
        return {f"{lead}{k}": v / w if rest > LEAST_WEIGHT else None for k, v, w, rest in zip(HALF_LIVES, sums, weight, left)}

    def _partners(self, pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """The other stage's newest label of each row's wafer as known before the row; the labels are written back by block."""
        mine, rows = pdf["wafer"].notna().to_numpy(), pdf[["wafer", "y", "t", "at"]]
        label = mine & (pdf["kind"] == OTHER).to_numpy() & rows["y"].notna().to_numpy()
        named = {int(b) for b in np.unique(rows["wafer"].to_numpy()[mine].astype("int64") // BLOCK)}
        found = {b: self.wafers.getValue((b,)) for b in named}
        kept = np.concatenate([np.empty(0, WAFER), *[np.frombuffer(bytes(v[0]), WAFER) for v in found.values() if v is not None]])
        # the labels of before stand in front of the rows; a row sees the last label of its wafer up to there
        both = pd.concat([pd.DataFrame(kept), rows[mine].astype({"wafer": "int64"})], ignore_index=True)
        is_label = np.concatenate([np.ones(len(kept), bool), label[mine]])
        at = pd.Series(np.where(is_label, np.arange(len(both)), np.nan)).groupby(both["wafer"].to_numpy()).ffill().to_numpy()
        seen = np.full(len(pdf), -1)
        seen[mine] = np.where(np.isnan(at), -1, at)[len(kept):].astype("int64")
        partner = pd.DataFrame({c: pd.api.extensions.take(both[c].to_numpy(float), seen, allow_fill=True) for c in ("y", "t", "at")})
        fresh = both[len(kept):][label[mine]]
        if len(fresh):
            now = both[is_label].drop_duplicates("wafer", keep="last")
            block, touched = now["wafer"].to_numpy() // BLOCK, set((fresh["wafer"].to_numpy() // BLOCK).tolist())
            order = np.argsort(block, kind="stable")
            out, block = np.empty(len(now), WAFER), block[order]
            for c in WAFER.names:
                out[c] = now[c].to_numpy()[order]
            cuts = np.flatnonzero(np.diff(block)) + 1
            for b, part in zip(block[np.concatenate([[0], cuts])].tolist(), np.split(out, cuts)):
                if b in touched:
                    self.wafers.updateValue((b,), (part.tobytes(),))
        return partner, fresh["at"].to_numpy(float)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        self.cleared.pop(tuple(key), None)
        # at an equal time the request goes first
        pdf = pdf.assign(_k=pdf["kind"] != RUN).sort_values(["at", "_k", "run_id"])
        zeros = [0.0] * len(HALF_LIVES)
        side = {k: [0, 0.0, 0.0, zeros, zeros] for k in (OWN, OTHER)}
        for k in side:
            if self.sides.containsKey((k,)):
                n, total, top, weight, sums = self.sides.getValue((k,))
                side[k] = [n, total, top, list(weight), list(sums)]
        recent = sorted(tuple(r) for r in self.recent.get()) if self.recent.exists() else []
        before, added, touched, out, dropped = len(recent), [], set(), [], False
        lives: dict[int, list | None] = {}
        changed: set[int] = set()
        partner, waiting = self._partners(pdf)

        def of(name: int):
            if name not in lives:
                lives[name] = tuple(self.lives.getValue((name,))) if self.lives.containsKey((name,)) else None
            return lives[name]

        full = 2 * before + PART
        for run, life, kind, at, t, y, p_y, p_t, p_at in zip(*(pdf[c] for c in ("run_id", "life", "kind", "at", "t", "y")), *(partner[c] for c in ("y", "t", "at"))):
            life = None if life is None or life != life else int(life)
            if kind == RUN:
                values = [v for _, v in recent[-LAST:]]
                mean = lambda k: sum(values[-k:]) / len(values[-k:]) if values else None
                n, total = side[OWN][:2]
                same = of(life) if life is not None else None
                other = p_at >= at - self.wait  # not so where there is no label
                out.append({"run_id": run, "at": at, "n": n, "mean": total / n if n else None, "last1": values[-1] if values else None,
                            "mean3": mean(3), "mean10": mean(LAST), "n24": len(recent) - bisect_left(recent, (at - DAY, float("-inf"))),
                            "age_h": (at - recent[-1][0]) / HOUR if recent else None, **self._decayed(side[OWN], at, ""),
                            "x_n": side[OTHER][0], **self._decayed(side[OTHER], at, "x_"),
                            "life_n": same[0] if same else 0, "life_mean": same[1] / same[0] if same else None,
                            "partner_y": p_y if other else None, "partner_lag_h": (p_t - t) / HOUR if other else None})
                if len(out) == PART:
                    yield frame(self.schema, key, out)
                    out = []
                continue
            if y is None or y != y:
                continue
            side[kind] = self._learn(side[kind], t, y)
            touched.add(kind)
            if kind == OWN:
                insort(recent, (t, y))
                if not dropped:
                    added.append((t, y))
                if len(recent) > full:  # rows to come are no earlier than this one
                    forget(recent, at - DAY, LAST)
                    full, dropped, added = 2 * len(recent) + PART, True, []
                if life is not None:
                    n, total, _ = of(life) or (0, 0.0, at)
                    lives[life] = (n + 1, total + y, at)
                    changed.add(life)

        for k in touched:
            self.sides.updateValue((k,), tuple(side[k]))
        size = len(recent)
        forget(recent, float(pdf["at"].min()) - DAY, LAST)
        if dropped or len(recent) < size:
            self.recent.put(recent)
        elif added:
            self.recent.appendList(added)
        for k in changed:
            self.lives.updateValue((k,), lives[k])
        # one timer a day, when the day's labels have been waited for
        ends = np.concatenate([waiting, [lives[k][2] for k in changed]]) + self.wait
        for day in np.unique(ends // DAY).astype("int64").tolist():
            self.handle.registerTimer(int((day + 1) * DAY * 1000))
        if out:
            yield frame(self.schema, key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.cleared.get(tuple(key)) == now:  # by another timer of this key since its last rows
            return iter(())
        self.cleared[tuple(key)] = now
        oldest = now / 1000 - self.wait
        for k in [k for k, v in self.lives.iterator() if v[2] < oldest]:
            self.lives.removeKey(k)
        left = []
        for k, v in self.wafers.iterator():
            labels = np.frombuffer(bytes(v[0]), WAFER)
            stay = ~(labels["at"] < oldest)
            if not stay.all():
                left.append((k, labels[stay].tobytes()))
        for k, labels in left:
            if labels:
                self.wafers.updateValue(k, (labels,))
            else:
                self.wafers.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass


def both_stages(rows: DataFrame) -> DataFrame:
    """Request and label rows (kind 1 and 0) with every label sent to its own regime and to that of the other stage."""
    other = F.concat(F.substring("regime", 1, 1), F.when(F.substring("regime", 2, 1) == "A", "B").otherwise("A"))
    to = F.when(F.col("kind") == RUN, F.array(F.struct(F.col("regime").alias("r"), F.lit(RUN).alias("k")))).otherwise(
        F.array(F.struct(F.col("regime").alias("r"), F.lit(OWN).alias("k")), F.struct(other.alias("r"), F.lit(OTHER).alias("k"))))
    return rows.withColumn("_to", F.explode(to)).withColumns({"regime": F.col("_to.r"), "kind": F.col("_to.k")}).drop("_to")


def arrived_history(stream: DataFrame, wait: float, late: str = "1 hour") -> DataFrame:
    """Stream of requests and labels keyed by (scenario, regime) to :class:`ArrivedHistory`; rows later than ``late``, or not after 1970, are dropped."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = both_stages(stream).withColumn("_ts", as_timestamp("at")).withWatermark("_ts", late)
    return rows.groupBy("scenario", "regime").transformWithStateInPandas(ArrivedHistory(wait), ArrivedHistory.schema, "Append", "EventTime")
