"""Arrived labels: work per request does not grow with the labels of a day or of a micro-batch."""

import time

import numpy as np
import pandas as pd

from fleetspark.streaming import processors as P


def crowded(n, span=3600.0):
    """n requests and n labels within an hour; wafers in an order of their own."""
    t = np.arange(n) * span / n
    one = pd.DataFrame({"run_id": np.arange(n), "kind": 1, "at": t + span, "t": t, "y": np.arange(n) % 7.0, "u": 0.0,
                        "life": 0, "wafer": np.random.default_rng(0).permutation(n)})
    return pd.concat([one, one.assign(kind=0, at=one["at"] + 0.1)])


def seconds(work):
    start = time.process_time()
    work()
    return time.process_time() - start


def test_a_label_is_not_read_again_for_each_request():
    def run(n):
        p = P.ArrivedLabels()
        return list(p.work(("s", "4A"), crowded(n), p.fresh(None)))
    assert sum(map(len, run(2000))) == 2000
    run(500)
    assert seconds(lambda: run(16000)) < 20 * seconds(lambda: run(2000))


def test_labels_leave_within_a_micro_batch(monkeypatch):
    monkeypatch.setattr(P, "PART", 100)
    p, q = P.ArrivedLabels(), P.ArrivedLabels()
    rows = crowded(3000, 30 * P.DAY)
    sizes, state = [], p.fresh(None)
    learn = p.learn
    p.learn = lambda s, *a: (learn(s, *a), sizes.append(len(s["labels"])))
    got = pd.concat(p.work(("s", "4A"), rows, state), ignore_index=True)
    assert max(sizes) < 500 and len(got) == 3000
    monkeypatch.setattr(P, "PART", 10**9)
    whole = pd.concat(q.work(("s", "4A"), rows, q.fresh(None)), ignore_index=True)
    pd.testing.assert_frame_equal(got, whole)
