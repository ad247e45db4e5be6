"""Interval rule, smoothing and fallback."""

import random

import pytest
from pyspark.sql import functions as F

from streampace.functions import intervals as fi
from streampace.operators import control
from streampace.operators.control import Smoothing

RULE_CASES = [
    (1000.0, 0.9, 1100), (10.0, 0.9, 30000), (100000.0, 1.0, 100), (500.0, 0.0, 2000),
    (5000.0, 0.9, 379), (5000.0, 0.3, 1460), (-50.0, 0.8, 2000), (0.0, 0.8, 2000),
    (0.5, 1.0, 30000), (700.0, 0.1, 1942),
]


def test_live_rule(spark):
    df = spark.createDataFrame([c[:2] for c in RULE_CASES], "rate double, conf double")
    got = [r[0] for r in df.select(fi.interval_ms(F.col("rate"), F.col("conf"))).collect()]
    assert got == [c[2] for c in RULE_CASES]
    # A lower confidence stays closer to the fallback.
    assert abs(got[5] - 2000) < abs(got[4] - 2000)


def test_backtest_rule(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (333.0,), (5000.0,), (1e6,)], "rate double")
    got = [r[0] for r in df.select(fi.interval_ms(F.col("rate"), rule=fi.BACKTEST)).collect()]
    assert got == [5000.0, 5000.0, 500 / 333 * 1000, 100.0, 100.0]


def test_ticks_round_half_to_even(spark):
    df = spark.createDataFrame([(10.0,), (150.0,), (250.0,), (251.0,)], "ms double")
    assert [r[0] for r in df.select(fi.ticks_of(F.col("ms"), 100)).collect()] == [1, 2, 2, 3]


def test_override_guard(spark):
    df = spark.createDataFrame([(-1, 700), (0, 700), (300, 700)], "o int, c int")
    assert [r[0] for r in df.select(fi.effective_interval(F.col("o"), F.col("c"))).collect()] == [
        700, 700, 300]


def raw_table(spark, targets):
    rows = [(s, i, v) for s, values in targets.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, step long, raw_ms long")


def test_smoother_cases(spark, by_series):
    cases = {
        "first": [2000], "jump": [2000, 100], "spike": [500, 20000], "converge": [2000] + [500] * 20,
        "floor": [200] + [1] * 50, "ceiling": [15000] + [999999] * 50,
    }
    got = by_series(control.smooth_intervals(raw_table(spark, cases)), "smoothed_ms")
    assert got["first"] == [2000]
    assert got["jump"][1] >= 1000
    assert got["spike"][1] == 1000
    assert got["converge"] == sorted(got["converge"], reverse=True) and got["converge"][-1] < 700
    assert min(got["floor"][1:]) >= 100 and max(got["ceiling"]) <= 30000


def loop(targets, rule, failures=False, recovers=True):
    """Step-by-step reading of the rules; returns (interval, failed run, fallback) per step."""
    current, errors, run, out = -1, 0, 0, []
    for target in targets:
        if target is None:
            run += 1
            errors += 1
            if failures and errors >= 3:
                current = rule.fallback_ms
                if recovers:
                    errors = 0
        else:
            errors = run = 0
            if current <= 0:
                current = target
            else:
                value = int(rule.alpha * target + (1 - rule.alpha) * current)
                value = max(value, int(current * rule.max_shrink))
                value = min(value, int(current * rule.max_expand))
                current = min(max(value, rule.min_ms), rule.max_ms)
        out.append((current, run, run >= 3))
    return out


def random_targets(seed, nulls):
    rng = random.Random(seed)
    series = {}
    for i in range(12):
        n = rng.choice([1, 2, 7, 8, 9, 16, 17, 40, 100])
        level = rng.choice([50, 500, 5000, 40000])
        values = [None if rng.random() < nulls else rng.randint(1, 2 * level) for _ in range(n)]
        series[f"s{i:02d}"] = values
    series["flat"] = [3000] * 30
    series["silent"] = [None] * 20
    series["late"] = [None] * 10 + [90000, 50, None, None, None, None, 800]
    return series


@pytest.mark.parametrize("rule", [Smoothing(), Smoothing(alpha=0.8), Smoothing(max_shrink=0.9)])
@pytest.mark.parametrize("size", [8, 1 << 16])
def test_smoothing_equals_loop(spark, by_series, rule, size):
    targets = random_targets(1, 0.1)
    got = by_series(control.smooth_intervals(raw_table(spark, targets), rule=rule, size=size),
                    "smoothed_ms")
    for s, values in targets.items():
        assert got[s] == [x[0] for x in loop(values, rule)], s


@pytest.mark.parametrize("recovers", [True, False])
@pytest.mark.parametrize("size", [8, 1 << 16])
def test_fallback_equals_loop(spark, by_series, recovers, size):
    targets = random_targets(2, 0.5)
    df = control.smooth_intervals(raw_table(spark, targets), failures=True, recovers=recovers,
                                  size=size).cache()
    got = [by_series(df, c) for c in ("smoothed_ms", "failed_run", "fallback")]
    for s, values in targets.items():
        want = loop(values, Smoothing(), True, recovers)
        assert list(zip(*[g[s] for g in got])) == want, s


def test_changes_convergence_and_fallback_rate(spark):
    smoothed = control.smooth_intervals(raw_table(spark, {"a": [2000] + [500] * 20}))
    assert control.interval_changes(smoothed).count() == sum(
        abs(r - s) > 100 for r, s in smoothed.select("raw_ms", "smoothed_ms").collect())
    done = control.convergence(smoothed.withColumn("goal", F.lit(500)), "goal").collect()[0]
    values = [r[0] for r in smoothed.orderBy("step").select("smoothed_ms").collect()]
    assert done["converged_step"] == next(i for i, v in enumerate(values) if abs(v - 500) <= 50)
    failing = control.smooth_intervals(
        raw_table(spark, {"a": [100, None, None, None, None, 100, 100, 100, 100, 100]}), failures=True)
    assert control.fallback_rate(failing).collect()[0]["fallback_pct"] == pytest.approx(20.0)


def test_invalid_smoothing_is_refused():
    with pytest.raises(ValueError):
        Smoothing(alpha=0)


@pytest.mark.parametrize("size", [2, 4, 8, 32])
def test_gaps_do_not_change_what_later_chunks_start_from(spark, size):
    rng = random.Random(4)
    rows = [("a", i, rng.choice([None, 200, 9000, 26_000])) for i in range(40) if i not in (7, 15, 16, 17, 18, 19, 31)]
    df = spark.createDataFrame(rows, "series_id string, step long, raw_ms long")
    cut = control.smooth_intervals(df, size=size).select("step", "smoothed_ms")
    whole = control.smooth_intervals(df).select("step", "smoothed_ms")
    assert sorted(cut.collect()) == sorted(whole.collect())
