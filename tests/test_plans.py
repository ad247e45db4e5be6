"""Plans that must hold at scale."""

import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from streampace.operators import features, forecast, lag, policy, score, series
from streampace.plans import folds
from streampace.plans.durable import broadcast_if_small, durable, released
from streampace.workloads import bindings as b

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_the_columns_used(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(series.bucket_counts(
        b.events(spark, SF), ["event_type"])))
    assert schemas and all({f.split(":")[0] for f in s.split(",")} <= {"ts", "event_type"} for s in schemas)


@pytest.mark.parametrize("build", [
    lambda r: features.with_window(r), lambda r: lag.with_rolling_lag(r),
    lambda r: series.cap_series(r), lambda r: policy.fixed_batches(r, (1000,)),
    lambda r: policy.policy_metrics(policy.fixed_batches(r, (1000,))),
    lambda r: features.supervised(r), lambda r: series.with_regime(r),
])
def test_column_operators_stay_in_the_jvm_and_are_keyed(spark, make_series, build):
    text = plan(build(make_series({"a": [1, 2, 3]})))
    assert "Python" not in text and "InPandas" not in text
    assert "SinglePartition" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_events_are_scanned_once(spark):
    rates = series.rate_series(b.events(spark, SF), ["event_type"])
    assert "events.parquet" not in plan(rates)  # the stored counts are read instead
    assert plan(rates).count("Exchange hashpartitioning(series_id") <= 2


def test_windows_are_partitioned_by_chunk(spark, make_series):
    text = plan(features.with_window(make_series({"a": [1, 2, 3]})))
    for spec in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text):
        assert "series_id" in spec and "_chunk" in spec


def test_one_shuffle_for_all_window_features(spark, make_series):
    wide = forecast.forecasts(make_series({"a": range(40)}), ["last", "sma", "ema"])
    assert plan(wide).count("Exchange hashpartitioning") == 1
    report = score.error_report(score.score(forecast.to_long(wide, ["last", "sma", "ema"])))
    assert plan(report).count("Exchange hashpartitioning") == 2


def test_top_rows_are_limited_before_the_shuffle(spark, make_series):
    assert "WindowGroupLimit" in plan(series.recent(make_series({"a": [1, 2, 3]}), 2))


def test_broadcast_only_when_small(spark):
    stored = durable(spark.range(20))
    assert "strategy=broadcast" in broadcast_if_small(stored, 20)._jdf.queryExecution().analyzed().toString()
    assert "strategy" not in broadcast_if_small(stored, 19)._jdf.queryExecution().analyzed().toString()


def test_no_query_joins_all_pairs(spark):
    for name in ("rate_series", "ema_error_report", "label_steps", "asof_schedule_table", "lag_rolling"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def looked_up(state, starts, ends):
    return ends[max(int(np.searchsorted(starts, state, side="right")) - 1, 0)] if starts else state


@pytest.mark.parametrize("pairs", [folds.sparse_pairs, folds.dense_pairs])
def test_states_go_through_a_tree_of_maps(spark, pairs):
    """Against one map after the other, for one to many chunks, with gaps between them and maps of any size."""
    rng, rows, want, largest = random.Random(3), [], {}, []
    for series_id, count in (("one", 1), ("two", 2), ("many", 23), ("gaps", 9)):
        numbers = sorted(rng.sample(range(70), count)) if series_id == "gaps" else list(range(count))
        state = initial = rng.randrange(6)
        for at, number in enumerate(numbers):
            if pairs is folds.dense_pairs:
                starts, ends = list(range(6)), sorted(rng.randrange(6) for _ in range(6))
            else:
                starts = sorted(rng.sample(range(1, 9), rng.randrange(4)))
                starts, ends = [0, *starts] if starts else [], sorted(rng.sample(range(9), len(starts) + 1)) if starts else []
            following = numbers[at + 1] if at + 1 < count else number + 1
            rows.append((series_id, number, following, initial, starts, ends))
            state = looked_up(state, starts, ends)
            want[series_id, following] = state
    maps = durable(spark.createDataFrame(
        rows, "series_id string, _chunk long, _next long, _initial long, starts array<long>, ends array<long>"))
    seen = lambda nodes, keys: largest.append(nodes.groupBy(
        "series_id", (nodes.node / 2).cast("long")).count().agg({"count": "max"}).first()[0]) or pairs(nodes, keys)
    got = folds.chained(maps, ["series_id"], seen).collect()
    assert {(r["series_id"], r["_chunk"]): r["_enter"] for r in got} == want
    assert largest and max(largest) <= 2


def test_trigger_chains_stay_in_the_jvm(spark, make_series):
    trace = make_series({"a": [i * 37 % 90 for i in range(300)], "b": [5.0] * 40})
    batches = policy.reactive_batches(trace, size=64)
    assert batches.count() > 3
    text = plan(batches)
    assert "Python" not in text and "InPandas" not in text and "chains" in text


def test_quantiles_scan_their_input_once(spark):
    report = series.rate_summary(series.rate_series(b.events(spark, SF), ["event_type"]))
    text = plan(report)
    assert "events.parquet" not in text and "raise_error" not in text and text.count("counts-") >= 1
    assert "spans-" not in text           # the series itself is not read again


def test_tables_of_a_block_are_removed_when_it_ends(spark):
    with released() as kept:
        inner = durable(spark.range(5), "inner")
        kept.append(durable(inner.selectExpr("id + 1 AS id"), "outer"))
    assert kept[0].count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FAILED_READ_FILE|does not exist"):
        inner.collect()
