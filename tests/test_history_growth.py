"""Arrived history: wafers are read and written by block, and work per request does not grow with the labels of a day."""

from collections import Counter

import numpy as np
import pandas as pd

from fleetspark.streaming import history as H
from test_stream_growth import crowded, seconds


class Value:
    def __init__(self, kept, name, calls):
        self.kept, self.name, self.calls = kept, name, calls

    def getValue(self, k):
        self.calls[self.name] += 1
        return self.kept.get(k)

    def containsKey(self, k):
        return k in self.kept

    def updateValue(self, k, v):
        self.calls[self.name] += 1
        self.kept[k] = v

    def removeKey(self, k):
        del self.kept[k]

    def iterator(self):
        return iter(list(self.kept.items()))

    def exists(self):
        return bool(self.kept)

    def get(self):
        return iter(self.kept["list"])

    def put(self, rows):
        self.kept["list"] = list(rows)

    def appendList(self, rows):
        self.kept.setdefault("list", []).extend(rows)


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), []

    def getMapState(self, name, *_):
        return Value({}, name, self.calls)

    getListState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


class Now:
    def __init__(self, seconds):
        self.seconds = seconds

    def getCurrentWatermarkInMs(self):
        return int(self.seconds * 1000)


def test_wafers_are_read_and_written_by_block_and_leave_by_timer():
    h, p, n = Handle(), H.ArrivedHistory(H.DAY), 4000
    p.init(h)
    rows = crowded(n)
    labels = rows[rows["kind"] == 0].assign(kind=H.OTHER)
    assert list(p.handleInputRows(("s", "4A"), iter([labels]), None)) == []
    got = pd.concat(p.handleInputRows(("s", "4A"), iter([rows[rows["kind"] == 1].assign(at=9000.0)]), None))
    assert got["partner_y"].notna().all() and h.calls["wafers"] <= 3 * (n // H.BLOCK + 1)
    assert dict(zip(got["run_id"], got["partner_y"])) == dict(zip(labels["run_id"], labels["y"]))
    edge = float(labels["at"].median())
    list(p.handleExpiredTimer(("s", "4A"), Now(edge + H.DAY), None))
    kept = [w for (b,), in [(k,) for k in p.wafers.kept] for w in np.frombuffer(p.wafers.kept[(b,)][0], H.WAFER)["at"]]
    assert len(kept) == n // 2 and min(kept) >= int(edge * 1000) / 1000


def test_a_crowded_day_is_history_in_one_pass():
    def run(n):
        p = H.ArrivedHistory(H.DAY)
        p.init(Handle())
        return sum(map(len, p.handleInputRows(("s", "4A"), iter([crowded(n)]), None)))
    assert run(2000) == 2000
    assert seconds(lambda: run(16000)) < 20 * seconds(lambda: run(2000))


def test_history_lookups_carry_sums_of_lines_not_lists(spark, monkeypatch):
    """Trends over 40 labels are sums on the label row, so a lookup sorts and stores numbers only."""
    from fleetspark.operators import arrivals as A
    carried, past = [], A._past

    def seen(queries, labels, keys, k, payload, out, rows):
        carried.extend(t for _, t in labels.select(*[v.alias(n) for n, v in payload.items()]).dtypes)
        return past(queries, labels, keys, k, payload, out, rows)

    monkeypatch.setattr(A, "_past", seen)
    df = spark.createDataFrame([("a", float(i), i, float(i % 5), True) for i in range(30)], "regime string, t_end double, run_id long, y double, measured boolean")
    out = A.past_block(df, df, ["regime"], A.Clock(delay=1.0))
    assert carried and not [t for t in carried if "array" in t]
    assert out.filter("P_trend40 is not null").count() == 25
