"""Registered queries against their SQL twins, on whole small tables; some again with every larger key forced to be sliced."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

from conftest import DATA

NAMES = ["naive_answer_score", "time_to_next_fault", "since_gap_stop_and_change", "rolling_stats_wide", "step_zscores", "excursion_events",
         "rolling_curve_residual", "weighted_thinning", "decide_answers", "roc_auc_and_average_precision", "densest_fault_window", "run_physics",
         "shape_timing", "resampled_trajectories", "schedule_features", "range_counts", "sequence_neighbors", "leave_one_out_kernels",
         "history_of_arrived_labels", "look_ahead_labels", "two_sided_estimates", "nested_blend", "walk_forward_blend", "paired_bootstrap",
         "rank_correlation", "before_after_reset", "missing_patterns", "fixed_lag_smoother", "stream_window_stats", "stream_history_features",
         "stream_arrived_history", "stream_online_estimates", "stream_progress_rows", "nearest_in_state", "weighted_state_at_scales"]
SLICED = ["since_gap_stop_and_change", "rolling_stats_wide", "weighted_quantile", "group_median_deviation", "life_ids", "stable_event_order",
          "asof_previous_and_next_label", "ewma_level"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def compare(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, rel.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    compare(spark, con, name)


@pytest.mark.parametrize("name", SLICED)
def test_twin_sliced(sliced, con, name):
    compare(sliced, con, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
