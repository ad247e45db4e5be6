"""Messages, latency, windows and result files."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from streampace.operators import events
from streampace.sources import readers

UTC = timezone.utc
START = datetime(2024, 1, 1)


@pytest.fixture
def raw(spark):
    at = datetime(2024, 1, 1, 0, 0, 10, 500000, tzinfo=UTC)
    bodies = [
        '{"ts": 1704067209.2504, "value": 3, "rate_target": 100, "second": 9, "payload": "x"}',
        '{"ts": 1704067209.0, "value": 4}', 'not json', '{"ts": null, "value": 1}', None,
        '{"ts": 1704067211.0, "value": 5, "rate_target": 800, "second": 11, "payload": ""}',
    ]
    rows = [(b.encode() if b is not None else None, at) for b in bodies]
    return spark.createDataFrame(rows, "value binary, timestamp timestamp")


def test_parse(raw):
    rows = events.parse_messages(raw).collect()
    assert (rows[0]["value"], rows[0]["rate_target"], rows[0]["payload"]) == (3, 100, "x")
    assert rows[0]["event_time"].microsecond == 250000      # cut to milliseconds
    assert rows[1]["value"] == 4 and rows[1]["rate_target"] is None
    assert all(rows[i]["producer_ts"] is None for i in (2, 3, 4))
    assert all(r["ingest_ts"] is not None for r in rows)


def test_latency_exact_and_truncated(raw):
    done = F.lit("2024-01-01 00:00:10.75").cast("timestamp")
    parsed = events.parse_messages(raw)
    exact = events.latency_rows(events.with_latency(parsed, done)).collect()
    assert exact[1]["e2e_latency_ms"] == pytest.approx(1750.0)
    assert exact[1]["kafka_latency_ms"] == pytest.approx(250.0, abs=1e-3)
    assert exact[5]["e2e_latency_ms"] == pytest.approx(-250.0)
    cut = events.latency_rows(events.with_latency(parsed, done, truncate_seconds=True)).collect()
    assert cut[1]["e2e_latency_ms"] == pytest.approx(1000.0)
    assert cut[1]["kafka_latency_ms"] == 0.0
    assert exact[2]["e2e_latency_ms"] is None
    assert events.with_latency(parsed).filter(F.col("e2e_latency_ms") > 0).count() == 3


def test_latency_stats_and_distribution(spark):
    rows = [(1, float(i)) for i in range(101)] + [(2, 5.0)]
    df = spark.createDataFrame(rows, "rate_target int, e2e_latency_ms double")
    for exact in (True, False):
        got = {r["rate_target"]: r for r in events.latency_stats(df, exact=exact).collect()}
        assert (got[1]["events"], got[1]["avg_latency_ms"]) == (101, 50.0)
        assert (got[1]["p50_ms"], got[1]["p95_ms"], got[1]["p99_ms"]) == (50, 95, 99)
        assert got[2]["p99_ms"] == 5.0
    shares = {r["latency_ms"]: r["cumulative"] for r in events.latency_distribution(
        df.filter("rate_target = 1"), width_ms=10.0).collect()}
    assert shares[0.0] == pytest.approx(10 / 101) and shares[100.0] == 1.0


def test_windows_and_counts(spark):
    rows = [(datetime(2024, 1, 1, 0, 0, s, tzinfo=UTC), s, "burst" if s > 3 else "normal")
            for s in (0, 1, 2, 3, 4, 9)]
    df = spark.createDataFrame(rows, "event_time timestamp, rate_target int, phase string")
    counted = sorted(tuple(r) for r in events.windowed_count(df, "2 seconds", "event_time").collect())
    assert [r[2] for r in counted] == [2, 2, 1, 1]
    stats = events.windowed_stats(df, "2 seconds", watermark=None).orderBy("window_start").collect()
    assert [(r["event_count"], r["avg_rate_target"]) for r in stats] == [
        (2, 0.5), (2, 2.5), (1, 4.0), (1, 9.0)]
    assert {r["phase"]: r["events"] for r in events.count_by(df, "phase").collect()} == {
        "normal": 4, "burst": 2}


def test_results_per_mode(spark, tmp_path):
    for mode, n in (("fixed_2s", 3), ("adaptive", 5)):
        spark.range(n).select(F.col("id").cast("double").alias("producer_ts")).write.json(
            str(tmp_path / mode))
    got = events.events_per_mode(readers.read_results(spark, str(tmp_path)))
    assert {r["mode"]: r["events"] for r in got.collect()} == {"fixed_2s": 3, "adaptive": 5}


def test_sources(spark):
    rate = readers.read_rate(spark, 200, "5s")
    assert rate.isStreaming and rate.columns == ["timestamp", "value"]
    assert readers.read_rate(spark, per_batch=5).isStreaming
    assert readers.kafka_options("h:1", "t") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "latest"}
    timed = events.event_table(spark.readStream.format("rate").load().select(
        F.lit("{}").cast("binary").alias("value"), "timestamp"))
    assert timed.isStreaming and "event_time" in timed.columns


def test_sketches_merge_over_any_range_and_group(spark):
    rng = np.random.default_rng(4)
    values = rng.lognormal(3, 2, 60_000)
    rows = [(START + timedelta(seconds=i), "ab"[i % 3 == 0], float(v)) for i, v in enumerate(values)]
    rows += [(START, "none", None), (START, "a", None)]
    df = spark.createDataFrame(rows, "event_time timestamp, rate_target string, e2e_latency_ms double")
    stored = events.latency_sketches(df, "1 hour", k=400)
    assert stored.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    got = {r.rate_target: r for r in events.merged_latency(stored, k=400).collect()}
    assert (got["none"].events, got["none"].p50_ms, got["none"].avg_latency_ms) == (1, None, None)
    for g, mine in (("b", values[::3]), ("a", np.delete(values, np.s_[::3]))):
        assert got[g].events == len(mine) + (g == "a") and got[g].avg_latency_ms == pytest.approx(mine.mean())
        for name, p in events.PERCENTILES.items():
            assert abs((mine <= got[g][name]).mean() - p) < 0.02, (g, name)      # the error of the rank
    hour = events.merged_latency(stored, [], str(START + timedelta(hours=2)), str(START + timedelta(hours=3)), k=400).first()
    assert hour.events == 3600
    # Up to k values a sketch is exact.
    few = events.merged_latency(events.latency_sketches(df.filter("rate_target = 'b'").limit(300), "1 hour", k=400), k=400)
    want = np.sort([r.e2e_latency_ms for r in df.filter("rate_target = 'b'").limit(300).collect()])
    assert few.first().p50_ms == want[149]
