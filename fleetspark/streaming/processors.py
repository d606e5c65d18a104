"""Keyed stateful processors: time since an event, and what a regime knows from the labels that have arrived.

State is one pickled dictionary per key in the state store, bounded by time horizons; it survives executor loss with the checkpoint.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_EVENT = 1e7
HOUR = 3600.0
DAY = 24 * HOUR
PART = 50_000  # output rows that are held at once


def forget(labels: list[tuple], before: float, last: int) -> None:
    """Drop sorted (time, ...) labels from before a time, except the ``last`` ones."""
    del labels[:max(0, min(bisect_left(labels, (before, float("-inf"))), len(labels) - last))]


def frame(schema: str, key: tuple, out: list[dict]) -> pd.DataFrame:
    """Rows of a key under an output schema that begins with the key's columns; what a row lacks is null."""
    cols = [c.split() for c in schema.split(", ")]
    res = {name: pd.Series([r.get(name) for r in out], dtype="float64" if kind == "double" else object) for name, kind in cols[len(key):]}
    return pd.DataFrame({name: pd.Series([v] * len(out), dtype=object) for (name, _), v in zip(cols, key)} | res)


class Remembering(StatefulProcessor):
    """Keeps one dictionary per key; subclasses give ``fresh`` and ``work(key, rows, state)``, which yields rows in frames."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("state", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = pickle.loads(bytes(self.slot.get()[0])) if self.slot.exists() else self.fresh(key)
        yield from self.work(key, pd.concat(list(rows)), state)  # one key's rows of one micro-batch
        self.slot.update((pickle.dumps(state),))

    def close(self) -> None:
        pass


class SinceEvent(Remembering):
    """Seconds since the last flagged row per key, the row itself included, by event time.

    Event times are kept up to ``lateness`` seconds behind the newest row, and the last one before that, so a row that arrives
    in a later batch than its time still finds the event before it.
    """

    schema = "tool long, id long, since double"

    def __init__(self, lateness: float = DAY):
        self.lateness = lateness

    def fresh(self, key):
        return {"events": [], "newest": float("-inf")}

    def work(self, key, pdf, state):
        events = state["events"]
        for e in zip(pdf.loc[pdf["flag"], "t"], pdf.loc[pdf["flag"], "id"]):
            insort(events, e)
        since = []
        for row in zip(pdf["t"], pdf["id"]):
            k = bisect_right(events, row)
            since.append(row[0] - events[k - 1][0] if k else NO_EVENT)
        state["newest"] = max(state["newest"], pdf["t"].max())
        old = bisect_right(events, (state["newest"] - self.lateness, float("inf")))
        del events[:max(0, old - 1)]
        yield pd.DataFrame({"tool": key[0], "id": pdf["id"].to_numpy(), "since": since})


class ArrivedLabels(Remembering):
    """Labels join what a regime knows; runs get that knowledge as it was strictly before them, and an estimate.

    Input rows: run_id, kind (0 label, 1 run), at (arrival or request time), t (process end), y, u. A label that arrives more than
    ``lateness`` seconds behind the newest request is reported as late and not learned, and one of a run that the policy did not
    choose is ignored, however late it comes. The estimate is the mean of known labels decayed over ``half_life`` hours of process time; its width is twice
    the mean error of the estimates whose labels came within ``horizon`` seconds. Labels are kept for a day, or the last ten.
    """

    schema = ("scenario string, regime string, run_id long, kind string, at double, pred double, width double, n long, mean double, last1 double, "
              "mean3 double, mean10 double, n24 long, age_h double, chosen boolean")
    least = 10  # errors that a width needs
    last = 10  # labels kept however old they are

    def __init__(self, half_life: float = 8.0, horizon: float = 7 * DAY, lateness: float = float("inf"), policies: dict[str, dict] | None = None):
        self.half_life, self.horizon, self.lateness, self.policies = half_life, horizon, lateness, policies or {}

    def fresh(self, key):
        return {"labels": [], "n": 0, "sum": 0.0, "decayed": [0.0, 0.0, None], "open": {}, "kept": set(), "errors": [0, 0.0], "newest": float("-inf")}

    def learn(self, s: dict, t: float, y: float, guess: float | None) -> None:
        insort(s["labels"], (t, y))
        s["n"] += 1
        s["sum"] += y
        weight, total, top = s["decayed"]
        if top is None or t >= top:
            fade = 0.5 ** ((t - top) / HOUR / self.half_life) if top is not None else 0.0
            s["decayed"] = [weight * fade + 1.0, total * fade + y, t]
        else:
            share = 0.5 ** ((top - t) / HOUR / self.half_life)
            s["decayed"] = [weight + share, total + share * y, top]
        if guess is not None:
            s["errors"] = [s["errors"][0] + 1, s["errors"][1] + abs(y - guess)]

    def wanted(self, policy: dict, u: float, age_h: float | None) -> bool:
        """Every run; a hashed share; or that share and whatever comes long after the last known label."""
        kind = policy.get("policy", "all")
        if kind == "all" or u < policy["budget"]:
            return True
        return kind == "stale" and (age_h is None or age_h > policy["age_h"])

    def describe(self, s: dict, at: float) -> dict:
        """Reads the last ten labels and searches for the start of the day, however many labels a day has."""
        labels, y = s["labels"], [v for _, v in s["labels"][-self.last:]]
        mean = lambda k: sum(y[-k:]) / len(y[-k:]) if y else None
        weight, total, _ = s["decayed"]
        return {"pred": total / weight if weight else None, "width": 2 * s["errors"][1] / s["errors"][0] if s["errors"][0] >= self.least else None,
                "n": s["n"], "mean": s["sum"] / s["n"] if s["n"] else None, "last1": y[-1] if y else None, "mean3": mean(3), "mean10": mean(self.last),
                "n24": len(labels) - bisect_right(labels, (at - DAY, float("-inf"))), "age_h": (at - labels[-1][0]) / HOUR if y else None}

    def work(self, key, pdf, s):
        policy, out = self.policies.get(key[0], {}), []
        # At an equal time the run goes first: a label counts only from strictly after its arrival.
        pdf = pdf.assign(_k=1 - pdf["kind"]).sort_values(["at", "_k", "run_id"])
        full = 2 * len(s["labels"]) + PART
        for run, kind, at, t, y, u in zip(*(pdf[c] for c in ("run_id", "kind", "at", "t", "y", "u"))):
            if kind == 1:
                row = self.describe(s, at)
                row["chosen"] = self.wanted(policy, u, row["age_h"])
                s["open"][run] = (at, row["pred"], row["chosen"], self.wanted(policy, u, 0.0))
                s["newest"] = max(s["newest"], at)
                out.append({"run_id": run, "kind": "run", "at": at, **row})
            elif at < s["newest"] - self.lateness:
                out.append({"run_id": run, "kind": "late", "at": at, "n": s["n"]})
            elif run in s["open"]:
                _, guess, chosen, _ = s["open"].pop(run)
                if chosen:
                    self.learn(s, t, y, guess)
            elif self.wanted(policy, u, 0.0) or run in s["kept"]:
                s["kept"].discard(run)
                self.learn(s, t, y, None)
            if len(s["labels"]) > full:  # rows to come are no earlier than this one
                forget(s["labels"], min(at, s["newest"]) - DAY, self.last)
                full = 2 * len(s["labels"]) + PART
            if len(out) == PART:
                yield frame(self.schema, key, out)
                out = []
        # Past the horizon a run's estimate is forgotten; that its label is wanted is kept only where the draw does not say so.
        for r in [r for r, v in s["open"].items() if v[0] < s["newest"] - self.horizon]:
            _, _, chosen, drawn = s["open"].pop(r)
            if chosen and not drawn:
                s["kept"].add(r)
        forget(s["labels"], s["newest"] - DAY, self.last)
        yield frame(self.schema, key, out)


def since_event(stream: DataFrame, lateness: float = DAY) -> DataFrame:
    """Stream of (tool, id, t, flag) to (tool, id, since)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream.groupBy("tool").transformWithStateInPandas(SinceEvent(lateness), SinceEvent.schema, "Append", "None")


def arrived_labels(stream: DataFrame, **options) -> DataFrame:
    """Stream of label and run rows keyed by (scenario, regime) to what is known at each run; see :class:`ArrivedLabels`."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream.groupBy("scenario", "regime").transformWithStateInPandas(ArrivedLabels(**options), ArrivedLabels.schema, "Append", "None")
