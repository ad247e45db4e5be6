"""Trigger policies against step-by-step simulations."""

import random

import pytest
from pyspark.sql import functions as F

from streampace.operators import policy


def traces(seed=3, scale=1.0):
    rng = random.Random(seed)
    out = {}
    for i, n in enumerate([1, 5, 21, 22, 63, 64, 65, 200, 333]):
        level = rng.choice([3, 40, 150, 900])
        out[f"t{i}"] = [float(rng.randint(0, 2 * level)) * scale for _ in range(n)]
    out["zeros"] = [0.0] * 90
    out["burst"] = [20.0] * 60 + [1900.0] * 40 + [20.0] * 100
    return out


def cut(rates, first, next_jump):
    """Triggers at ``first`` and then wherever ``next_jump(i, rows)`` leads; (tick, rows) each."""
    out, backlog, target = [], 0.0, first
    for i, rate in enumerate(rates):
        backlog += rate
        if i >= target:
            rows = backlog * 0.1
            out.append((i, rows))
            backlog, target = 0.0, i + next_jump(i, rows)
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["series_id"], r["policy"], r["trigger_no"])):
        out.setdefault((r["series_id"], r["policy"]), []).append((r["tick"], r["rows"]))
        assert r["trigger_no"] == len(out[(r["series_id"], r["policy"])]) - 1
    return out


def same(got, want):
    for key in want:
        left = got.pop(key, [])
        assert [t for t, _ in left] == [t for t, _ in want[key]], key
        assert [r for _, r in left] == pytest.approx([r for _, r in want[key]], abs=1e-9), key
    assert not got


def test_published_trigger_counts(make_series):
    trace = make_series({"t": [441.8] * 1803})
    metrics = policy.policy_metrics(policy.fixed_batches(trace, policy.FIXED_INTERVALS_MS))
    got = {r["policy"]: r["triggers"] for r in metrics.collect()}
    assert got == {"fixed_100ms": 1802, "fixed_500ms": 360, "fixed_1000ms": 180, "fixed_2000ms": 90}


def test_fixed_equals_simulation(make_series):
    rates = traces()
    got = collected(policy.fixed_batches(make_series(rates), (100, 250, 700)))
    want = {}
    for s, values in rates.items():
        for ms in (100, 250, 700):
            p = max(1, round(ms / 100))
            batches = cut(values, p, lambda i, rows: p)
            if batches:
                want[(s, f"fixed_{ms}ms")] = batches
    same(got, want)


def ema(values, alpha=0.3):
    acc = values[0]
    for v in values[1:]:
        acc = alpha * v + (1 - alpha) * acc
    return acc


@pytest.mark.parametrize("size", [64, 1 << 16])
def test_adaptive_equals_simulation(make_series, size):
    rates = traces()
    got = collected(policy.adaptive_batches(make_series(rates), "ema", size=size))

    def jump(values):
        def inner(i, _):
            pred = ema(values[i - 29:i + 1]) if i >= 29 else values[i]
            ms = min(max(500 / max(pred, 0.1) * 1000, 100), 5000)
            return max(1, round(ms / 100))
        return inner

    want = {(s, "adaptive_ema"): b for s, v in rates.items() if (b := cut(v, 10, jump(v)))}
    same(got, want)


@pytest.mark.parametrize("size", [32, 1 << 16])
def test_reactive_equals_simulation(make_series, size):
    rates = traces()
    got = collected(policy.reactive_batches(make_series(rates), size=size))
    want = {(s, "reactive"): b for s, v in rates.items()
            if (b := cut(v, 20, lambda i, rows: 5 if rows > 200 else 20))}
    same(got, want)


def test_compare_is_the_same_in_chunks(make_series):
    trace = make_series(traces(scale=3.0))
    def rows(size):
        df = policy.compare_policies(trace, ("ema", "sma"), size=size)
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                      for r in df.collect())
    assert rows(64) == rows(1 << 16)


def test_metrics_by_hand(spark):
    rows = [("a", "p", i, 10 * i, float(r)) for i, r in enumerate([5, 100, 40, 100, 0, 10, 9])]
    rows += [("b", "p", i, i, 4.0) for i in range(3)]
    batches = spark.createDataFrame(
        rows, "series_id string, policy string, trigger_no long, tick long, rows double")
    for size in (2, 1 << 16):
        got = {r["series_id"]: r for r in policy.policy_metrics(batches, size=size).collect()}
        a = got["a"]
        assert (a["triggers"], a["peak_backlog"]) == (7, 100.0)
        assert a["empty_pct"] == pytest.approx(100 / 7)
        assert a["mean_batch"] == pytest.approx(264 / 6)
        assert a["throughput"] == pytest.approx(264 / 7)
        # The first of equal peaks counts: from trigger 1 to the first small batch, 4.
        assert (a["clearance_triggers"], a["clearance_s"]) == (3.0, pytest.approx(3.0))
        assert got["b"]["clearance_triggers"] == float("inf")


def test_no_triggers_and_savings(spark, make_series):
    trace = make_series({"short": [5.0] * 5, "long": [5.0] * 50})
    expected = trace.select("series_id").distinct().withColumn("policy", F.lit("fixed_1000ms"))
    batches = policy.fixed_batches(trace, (1000,))
    metrics = {r["series_id"]: r for r in policy.policy_metrics(batches, expected=expected).collect()}
    assert metrics["short"]["triggers"] == 0 and metrics["short"]["mean_batch"] == 0.0
    assert metrics["short"]["clearance_s"] == float("inf")
    many = policy.policy_metrics(policy.fixed_batches(trace, (500, 1000)))
    saved = {r["policy"]: r["savings_pct"] for r in policy.savings_vs(many).collect()}
    assert saved == {"fixed_500ms": pytest.approx((1 - 9 / 4) * 100), "fixed_1000ms": 0.0}
    alone = policy.savings_vs(policy.policy_metrics(policy.fixed_batches(trace, (500,))))
    assert alone.collect()[0]["savings_pct"] == pytest.approx((1 - 9) * 100)


def test_policy_order(spark):
    names = ["reactive", "fixed_500ms", "adaptive_ema", "fixed_1000ms"]
    df = spark.createDataFrame([("t", n) for n in names], "series_id string, policy string")
    assert [r["policy"] for r in policy.order_policies(df).collect()] == [
        "fixed_1000ms", "fixed_500ms", "adaptive_ema", "reactive"]
