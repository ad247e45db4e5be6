"""Progress logs."""

import json
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest

from streampace.operators import progress
from streampace.sources.progress import ProgressLog, progress_row, read_progress

UTC = timezone.utc


def row(app, run, batch, second, rows, rate=1.0, duration=100, dropped=0):
    return (app, run, batch, datetime(2024, 1, 1, 0, 0, second, tzinfo=UTC), rows, rate, duration, dropped, False)


@pytest.fixture
def log(spark):
    rows = [row("x", "r1", b, b, 100 * b, float(b)) for b in range(4)]
    rows += [row("x", "r1", b, b + 10, 999, 9.0) for b in range(3)]             # reported again
    rows += [row("y", "r2", 0, 5, 0, None), row("y", None, 1, 6, 7), row("y", "r2", None, 7, 7)]
    return spark.createDataFrame(rows, progress.PROGRESS_SCHEMA)


def test_dedup_keeps_the_first_report(log):
    got = {(r["run_id"], r["batch_id"]): r["num_input_rows"]
           for r in progress.dedup_progress(log).collect()}
    assert got == {("r1", 0): 0, ("r1", 1): 100, ("r1", 2): 200, ("r1", 3): 300, ("r2", 0): 0}
    assert progress.dedup_progress(log).columns == log.columns


def test_apps_bursts_and_series(log):
    assert progress.for_app(log).select("app_name").distinct().collect()[0][0] == "x"
    assert progress.for_app(log, "y").count() == 3
    assert progress.for_app(log, "none").count() == 0
    flags = progress.burst_flags(progress.dedup_progress(log))
    assert flags.filter("is_burst").count() == 1        # above 200, not at it
    rates = progress.progress_series(progress.dedup_progress(log))
    assert {tuple(r) for r in rates.filter("series_id = 'r2'").collect()} == {("r2", 0, 0.0)}


def test_durations(spark):
    rows = [("vanilla", d) for d in (100, 200, 300)] + [("agent", d) for d in (200, 220)]
    df = spark.createDataFrame(rows, "mode string, batch_duration_ms long")
    got = {r["mode"]: r for r in progress.compare_modes(
        progress.duration_summary(df), "vanilla").collect()}
    assert (got["vanilla"]["batches"], got["vanilla"]["median_ms"]) == (3, 200.0)
    assert got["vanilla"]["p95_ms"] == pytest.approx(290.0)
    assert got["agent"]["mean_ms_change_pct"] == pytest.approx(5.0)
    assert got["agent"]["median_ms_change_pct"] == pytest.approx(5.0)


def test_late_report(spark):
    df = spark.createDataFrame(
        [row("x", "r", 0, 0, 10), row("x", "r", 1, 1, 10, dropped=3)], progress.PROGRESS_SCHEMA)
    assert tuple(progress.late_report(df).collect()[0]) == ("r", 20, 3, 1)


def test_offset_lag(spark):
    df = spark.createDataFrame(
        [('{"t": {"0": 15, "1": 7}, "u": {"0": 2}}', '{"t": {"0": 5, "1": 7}, "u": {"0": 1}}')],
        "latest string, read string")
    assert df.select(progress.offset_lag("latest", "read")).collect()[0][0] == 11


REPORT = {"runId": "r", "batchId": 4, "timestamp": "2024-01-01T00:00:01.000Z", "numInputRows": 12,
          "inputRowsPerSecond": 6.5, "batchDuration": 90,
          "stateOperators": [{"numRowsDroppedByWatermark": 2}]}


def test_report_rows():
    got = progress_row("app", REPORT)
    assert got[:3] == ("app", "r", 4) and got[4:] == (12, 6.5, 90, 2, False)
    idle = progress_row("app", {k: REPORT[k] for k in ("runId", "batchId", "timestamp")})
    assert idle[4:] == (0, 0.0, 0, 0, False)


def test_listener_writes_reports_and_idle_rows(spark, tmp_path):
    """The callbacks are called directly: no listener server is started."""
    path = str(tmp_path / "log")
    log = ProgressLog(spark, path, flush_every=2)
    log.onQueryStarted(SimpleNamespace(runId="r"))
    log.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(json=json.dumps(REPORT))))
    log.onQueryIdle(SimpleNamespace(runId="r", timestamp="2024-01-01T00:00:02.000Z"))
    log.onQueryIdle(SimpleNamespace(runId="r", timestamp="2024-01-01T00:00:03.000Z"))
    log.onQueryTerminated(SimpleNamespace(runId="r"))
    got = read_progress(spark, path).orderBy("ts").collect()
    assert [(r["batch_id"], r["num_input_rows"], r["input_rows_per_second"]) for r in got] == [
        (4, 12, 6.5), (4, 0, 0.0), (4, 0, 0.0)]
    assert got[0]["rows_dropped_by_watermark"] == 2
    kept = progress.dedup_progress(read_progress(spark, path).unionByName(read_progress(spark, path)))
    rates = progress.progress_series(kept).orderBy("step").collect()
    assert [(r["step"], r["rate"]) for r in rates] == [(0, 6.5), (1, 0.0), (2, 0.0)]


def test_reports_do_not_wait_long(spark, tmp_path):
    log = ProgressLog(spark, str(tmp_path / "log"), flush_seconds=0)
    log.onQueryStarted(SimpleNamespace(runId="r"))
    log.onQueryIdle(SimpleNamespace(runId="r", timestamp="2024-01-01T00:00:02.000Z"))
    assert read_progress(spark, str(tmp_path / "log")).count() == 1
