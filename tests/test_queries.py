"""Queries against their SQL counterparts on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from streampace.workloads.oracles import ORACLES
from streampace.workloads.queries import QUERIES
from tools.check_queries import near, table

SF = "/root/testdata/sf0.001"
# One of each kind; tools/check_queries.py compares all of them.
CHECKED = [
    "parse_messages", "latency_rows_truncated", "latency_stats_exact", "windowed_stats",
    "progress_dedup", "duration_compare", "rate_series_orders", "label_steps", "asof_schedule_table",
    "window_norm", "lag_rolling", "supervised_windows", "spectral", "ensemble_recipes",
    "ema_error_report", "error_quantiles_by_regime", "smoothed_intervals", "fallback_intervals",
    "policy_compare", "stream_windowed_stats", "stream_recommend",
]


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    result = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(result.columns)
    got, want = table(df.collect(), df.columns), table(result.fetchall(), result.columns)
    assert len(got) == len(want) > 0
    assert all(near(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
