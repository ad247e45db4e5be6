"""Streams against the batch operators: several micro-batches, late rows, restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from streampace.operators import control, events, features, forecast, progress, series
from streampace.sources import readers, replay
from streampace.sources.progress import progress_frame
from streampace.streaming import late, recommend, sinks

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "event_time timestamp, rate_target int, key string"


def write_file(spark, path, rows, schema=SCHEMA):
    """One more file, later than the ones before."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(stream, tmp_path, name, start=sinks.to_parquet):
    query = start(stream, str(tmp_path / name / "out"), str(tmp_path / name / "checkpoint"), "available")
    query.awaitTermination()
    return query, str(tmp_path / name / "out")


@pytest.fixture
def recorded(spark, tmp_path):
    rng = random.Random(4)
    path = str(tmp_path / "events")
    for part in range(4):
        seconds = sorted(rng.uniform(25 * part, 25 * part + 25) for _ in range(60))
        write_file(spark, path, [(at(s), rng.randint(1, 9), rng.choice("ab")) for s in seconds])
    return path


def test_windowed_stats_equal_batch(spark, tmp_path, recorded):
    stream = readers.replay_events(spark, recorded)
    query, out = run(events.windowed_stats(stream, "4 seconds"), tmp_path, "stats")
    assert query.lastProgress["batchId"] >= 3
    batch = events.windowed_stats(spark.read.parquet(recorded), "4 seconds", watermark=None)
    newest = spark.read.parquet(recorded).agg(F.max("event_time")).collect()[0][0]
    closed = batch.filter(F.col("window_end") <= F.lit(newest) - F.expr("INTERVAL 5 SECONDS"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, closed.collect()))


def test_late_rows_are_dropped_and_reported(spark, tmp_path):
    path = str(tmp_path / "late")
    write_file(spark, path, [(at(1), 1, "a"), (at(30), 1, "a")])
    write_file(spark, path, [(at(26), 2, "a"), (at(40), 1, "a")])       # 26: out of order, in time
    # A micro-batch drops what is behind the watermark that the batch before it started with, 25.
    write_file(spark, path, [(at(2), 9, "a"), (at(60), 1, "a")])
    query, out = run(events.windowed_stats(readers.replay_events(spark, path), "2 seconds"),
                     tmp_path, "late-out")
    got = {int((r["window_start"] - START.replace(tzinfo=None)).total_seconds()): r["event_count"]
           for r in spark.read.parquet(out).collect()}
    assert got == {0: 1, 26: 1, 30: 1, 40: 1}
    report = progress.late_report(progress.dedup_progress(progress_frame(query))).collect()
    assert (sum(r["input_rows"] for r in report), sum(r["dropped_rows"] for r in report)) == (6, 1)


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    path = str(tmp_path / "restart")
    write_file(spark, path, [(at(s), s, "a") for s in range(10)])
    run(events.windowed_stats(readers.replay_events(spark, path), "2 seconds"), tmp_path, "again")
    write_file(spark, path, [(at(s), s, "a") for s in range(10, 30)])
    _, out = run(events.windowed_stats(readers.replay_events(spark, path), "2 seconds"), tmp_path, "again")
    rows = sorted(tuple(r)[2:] for r in spark.read.parquet(out).collect())
    assert rows == [(2, s + 0.5) for s in range(0, 24, 2)]


def test_latency_json_and_running_stats(spark, tmp_path, recorded):
    def messages():
        return readers.replay_events(spark, recorded).select(
            F.to_json(F.struct(F.unix_micros("event_time").cast("double").alias("x"),
                               (F.unix_micros("event_time") / 1e6).alias("ts"), "rate_target")
                      ).cast("binary").alias("value"), F.col("event_time").alias("timestamp"))
    rows = events.with_latency(events.parse_messages(messages()))
    sinks.to_json(events.latency_rows(rows), str(tmp_path / "results" / "fixed_2s"),
                  str(tmp_path / "checkpoint"), "available").awaitTermination()
    written = readers.read_results(spark, str(tmp_path / "results"))
    assert written.count() == 240 and written.filter("e2e_latency_ms <= 0").count() == 0
    query = sinks.to_memory(events.latency_stats(rows, exact=False), "running_stats", "complete", "available")
    query.awaitTermination()
    assert spark.table("running_stats").agg(F.sum("events")).collect()[0][0] == 240


def test_progress_dedup_in_a_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "run_id string, batch_id long, ts timestamp, num_input_rows long"
    write_file(spark, path, [("r", 0, at(0), 5), ("r", 1, at(1), 6)], schema)
    write_file(spark, path, [("r", 1, at(2), 6), ("r", 2, at(2), 7), ("q", 1, at(2), 8)], schema)
    kept = progress.dedup_progress_stream(readers.replay_events(spark, path))
    _, out = run(kept, tmp_path, "dedup")
    assert sorted((r[0], r[1]) for r in spark.read.parquet(out).collect()) == [
        ("q", 1), ("r", 0), ("r", 1), ("r", 2)]


def test_recommendations_equal_batch_over_several_batches(spark, tmp_path, by_series):
    rng = random.Random(8)
    path, k = str(tmp_path / "live"), 5
    # A hot and a rare stream; idle gaps; four files in time order.
    seconds = sorted([rng.uniform(0, 60) for _ in range(600)] + [rng.uniform(80, 100) for _ in range(100)])
    for part in range(4):
        chunk = seconds[part * 175:(part + 1) * 175]
        write_file(spark, path, [(at(s), 1, "hot" if i % 9 else "rare") for i, s in enumerate(chunk)])
    rates = recommend.rate_stream(
        readers.replay_events(spark, path).withColumnRenamed("event_time", "ts"), ["key"], 1, "2 seconds")
    live = None
    # The rate table grows while the second query is stopped and started again.
    for more in ((120, 121, 121.5, 130), ()):
        _, table = run(rates, tmp_path, "rates")
        stored = readers.replay_events(spark, table, max_files_per_trigger=2)
        _, out = run(recommend.recommend_stream(stored, 1, k=k), tmp_path, "recommended")
        live = spark.read.parquet(out)
        if more:
            write_file(spark, path, [(at(s), 1, "hot") for s in more])
    first = live.groupBy("series_id").agg(F.min("step").alias("first"))
    rows = live.join(first, "series_id").withColumn("step", F.col("step") - F.col("first"))
    names = list(recommend.LIVE_MODELS)
    models = [*names[:3], forecast.ema_forecaster("ema_slow", 0.1), forecast.ema_forecaster("ema_fast", 0.7)]
    windows = forecast.confidence(forecast.predict_all(
        features.with_window(rows.select("series_id", "step", "rate"), k), models, k), names)
    batch = control.smooth_intervals(control.with_interval(forecast.warmup_forecast(
        windows.withColumn("confidence", F.round("confidence", 6)), k=k).drop("win"), "pred", "confidence"))
    for column in ("rate", "pred", "confidence", "raw_ms", "smoothed_ms"):
        got, want = by_series(rows, column), by_series(batch, column)
        assert set(got) == {"hot", "rare"}
        for s in got:
            assert got[s] == pytest.approx(want[s], rel=1e-12), (column, s)
    assert 0 < sum(0 < c < 1 for c in by_series(rows, "confidence")["hot"])
    # Every bucket between the first and the last closed one is there, with its events.
    assert by_series(rows, "step")["hot"] == list(range(len(by_series(rows, "step")["hot"])))
    stored = spark.read.parquet(path)
    last = live.filter("series_id = 'hot'").agg(F.max("step")).collect()[0][0]
    expected = stored.filter((F.col("key") == "hot") & (F.unix_seconds("event_time") <= last)).count()
    assert sum(by_series(rows, "rate")["hot"]) == expected


RATES = "series_id string, bucket long, rate double"


def paced(spark, tmp_path, files, **how):
    """Rows of each stream after all files, one file at a trigger, with a restart before the last one."""
    path = str(tmp_path / "rates")
    for file in files[:-1]:
        write_file(spark, path, file, RATES)
    how = {"bucket_seconds": 1, "k": 3, **how}
    stream = lambda: recommend.recommend_stream(readers.replay_events(spark, path), **how)
    run(stream(), tmp_path, "paced")
    write_file(spark, path, files[-1], RATES)
    query, out = run(stream(), tmp_path, "paced")
    rows = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r.series_id, r.step)):
        rows.setdefault(r.series_id, []).append(r)
    return query, rows


@pytest.mark.parametrize("recovers", [True, False])
def test_failures_fall_back_across_triggers(spark, tmp_path, make_series, by_series, recovers):
    lost = [0, 1, 6, 7, 8, 9, 10, 11, 14, 15, 16, 17]
    rates = [None if i in lost else 40.0 + 13 * i for i in range(20)]
    files = [[("a", i, rates[i]) for i in range(a, b)] for a, b in ((0, 1), (1, 7), (7, 8), (8, 16), (16, 20))]
    _, rows = paced(spark, tmp_path, files, recovers=recovers)
    got = rows["a"]
    assert [r.step for r in got] == list(range(20))
    known = [(i, r) for i, r in enumerate(rates) if r is not None]
    for n, (i, r) in enumerate(known):
        window = [v for _, v in known[max(0, n - 2):n + 1]]
        pred = window[0]
        for v in window[1:]:
            pred = 0.3 * v + 0.7 * pred
        pred = pred if len(window) == 3 else sum(window) / len(window)
        assert got[i].pred == pytest.approx(pred, rel=1e-12) and got[i].rate == r
    assert all(got[i].pred is None and got[i].raw_ms is None and got[i].rate is None for i in lost)
    raw = spark.createDataFrame([("a", r.step, r.raw_ms) for r in got], "series_id string, step long, raw_ms long")
    batch = control.smooth_intervals(raw, failures=True, recovers=recovers)
    for column in ("smoothed_ms", "failed_run", "fallback"):
        assert [r[column] for r in got] == by_series(batch, column)["a"], column
    assert got[0].smoothed_ms == -1 and [r.fallback for r in got][6:12] == [False, False, True, True, True, True]
    assert got[8].smoothed_ms == 2000


def test_silent_streams_expire_and_late_buckets_are_counted(spark, tmp_path):
    files = [[("a", 1, 5.0), ("b", 1, 7.0)], [("a", 2, 5.0), ("a", 3, 5.0)], [("a", 2, 9.0), ("a", 5, 5.0)],
             [("a", s, 5.0) for s in range(6, 40)], [("b", 40, 7.0), ("c", 41, 1.0), ("a", 45, 5.0)]]
    query, rows = paced(spark, tmp_path, files, expire_buckets=10, delay_buckets=3)
    assert [r.step for r in rows["a"]] == list(range(1, 46))
    assert [r.rate for r in rows["a"]][3:5] == [0.0, 5.0] and rows["a"][-1].late_buckets == 1
    # b was silent for 39 buckets: its state is gone, and it begins anew without as many zeros.
    assert [(r.step, r.rate, r.confidence) for r in rows["b"]] == [(1, 7.0, 0.0), (40, 7.0, 0.0)]
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1]["numRowsTotal"] <= 3


def test_an_expired_state_is_removed_by_its_timer(spark, tmp_path):
    files = [[("gone", 1, 5.0), ("a", 1, 1.0)], [("a", s, 1.0) for s in range(2, 60)], [("a", 60, 1.0)], [("a", 61, 1.0)]]
    query, rows = paced(spark, tmp_path, files, expire_buckets=10, delay_buckets=2)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] == 1 and len(rows["gone"]) == 1


def test_long_gaps_are_filled_in_pieces(spark, tmp_path):
    files = [[("a", 10, 300.0)], [("a", 9000, 300.0), ("a", 9001, 300.0)], [("a", 9003, 300.0)]]
    _, rows = paced(spark, tmp_path, files, expire_buckets=10_000)
    assert [r.step for r in rows["a"]] == list(range(10, 9004))
    assert sum(r.rate for r in rows["a"]) == 1200 and rows["a"][5000].smoothed_ms == 2000


@pytest.fixture
def scattered(spark, tmp_path):
    """A recording whose files hold rows of all times, in no order."""
    rng, path = random.Random(9), str(tmp_path / "scattered")
    rows = [(at(rng.uniform(0, 100)), rng.randint(1, 9), rng.choice("ab")) for _ in range(500)] + [(None, 1, "a")]
    for part in range(4):
        write_file(spark, path, rows[part::4])
    return path


@pytest.mark.parametrize("slice_seconds", [None, 7, 1000])
def test_a_recording_is_replayed_in_time_order_and_closed(spark, tmp_path, scattered, slice_seconds):
    timed = replay.replay_by_time(spark, scattered, "event_time", "1 second", slice_seconds, 10)
    stream = events.windowed_stats(timed, "4 seconds", watermark=None)
    query = replay.drain(sinks.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "c"), None))
    batch = events.windowed_stats(spark.read.parquet(scattered).filter("event_time IS NOT NULL"), "4 seconds", watermark=None)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect())) and len(got) == 25
    counted = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(counted) == 501 and len(counted) == (1 if slice_seconds != 7 else 15)


def test_a_whole_recording_is_closed(spark, tmp_path, scattered):
    timed = replay.replay_whole(spark, scattered, "event_time", "1 second", 10)
    _, out = run(events.windowed_stats(timed, "4 seconds", watermark=None), tmp_path, "whole")
    batch = events.windowed_stats(spark.read.parquet(scattered).filter("event_time IS NOT NULL"), "4 seconds", watermark=None)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


def test_a_replay_goes_on_from_its_checkpoint(spark, tmp_path, scattered):
    def start():
        timed = replay.replay_by_time(spark, scattered, "event_time", "1 second", 7, 10)
        return sinks.to_parquet(events.windowed_count(timed, "4 seconds", "event_time"), str(tmp_path / "out"), str(tmp_path / "c"), None)

    query = start()
    while not query.recentProgress or query.lastProgress["batchId"] < 3:
        query.awaitTermination(0.2)
    query.stop()
    before = query.lastProgress["batchId"]
    query = replay.drain(start())
    assert query.recentProgress[0]["batchId"] >= before
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("events")).collect()[0][0] == 500


def test_a_recording_without_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    write_file(spark, path, [])
    timed = replay.replay_by_time(spark, path, "event_time")
    query = replay.drain(sinks.to_parquet(timed, str(tmp_path / "out"), str(tmp_path / "c"), None))
    assert not [p for p in query.recentProgress if p["numInputRows"]]


def test_sinks_and_triggers(spark, tmp_path, capfd):
    assert sinks.trigger_for("fixed_5s") == "5 seconds" and sinks.trigger_for("other") == "2 seconds"
    numbers = readers.read_rate(spark, per_batch=10)
    with pytest.raises(ValueError):
        sinks.writer(numbers, "sometimes")
    query = sinks.to_console(numbers, trigger="500 milliseconds", rows=1)
    query.stop()
    count = events.windowed_count(numbers, "1 second")
    memory = sinks.to_memory(count, "window_counts", "complete", "500 milliseconds")
    try:
        deadline = datetime.now() + timedelta(seconds=60)
        while datetime.now() < deadline and not memory.lastProgress:
            memory.awaitTermination(1)
    finally:
        memory.stop()
    assert spark.table("window_counts").agg(F.sum("events")).collect()[0][0] >= 10


def test_csv_reports(spark, tmp_path):
    scored = spark.createDataFrame(
        [("s", 0, 1.0, "m", 2.0, 1.0, 100.0), ("s", 0, 1.0, "n", 1.0, 0.0, 0.0)],
        "series_id string, step long, actual double, model string, pred double, abs_err double, mape double")
    sinks.write_predictions_csv(scored, str(tmp_path / "p"), ["m", "n"])
    got = spark.read.option("header", True).csv(str(tmp_path / "p"))
    assert got.columns == ["series_id", "step", "actual", "pred_m", "abserr_m", "mape_m", "pred_n",
                           "abserr_n", "mape_n"]
    summary = spark.createDataFrame([("fixed", 60.2, 0, 17)],
                                    "approach string, elapsed_sec double, exit_code int, stdout_lines int")
    sinks.write_summary_csv(summary, str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).collect()[0]["exit_code"] == "0"


def test_series_of_a_replay(spark, recorded):
    table = spark.read.parquet(recorded).withColumnRenamed("event_time", "ts")
    assert series.rate_series(table, ["key"], 1).agg(F.sum("rate")).collect()[0][0] == 240


def test_late_rows_are_kept_and_reconciled(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id long, ts timestamp"
    # A micro-batch drops what is behind the watermark that the batch before it started with: 3 is in time, 5 and 6 are not,
    # and neither is 8, behind 35, though its window would still be open.
    files = [[(1, at(1)), (2, at(30))], [(3, at(26)), (4, at(40))], [(5, at(2)), (6, at(3)), (7, at(60))], [(8, at(34.5))],
             [(None, at(900))]]
    for file in files:
        write_file(spark, path, file, schema)
    known = F.unix_seconds("ts") < int(at(900).timestamp())       # not the closing row
    stream = lambda: late.accepted(readers.replay_events(spark, path), "id", "ts", "5 seconds")
    _, out = run(events.windowed_count(stream().filter(known), "2 seconds", "ts"), tmp_path, "counted")
    _, kept = run(stream().select("id"), tmp_path, "accepted")
    received = spark.read.parquet(path).filter(known)
    missed = late.late_rows(received, spark.read.parquet(kept), "id")
    assert sorted(r.id for r in missed.collect()) == [5, 6, 8]
    whole = late.reconciled(spark.read.parquet(out), missed, "2 seconds", "ts").collect()
    assert sum(r.events for r in whole) == 8 and sum(r.late for r in whole) == 3
    want = events.windowed_count(received, "2 seconds", "ts").collect()
    assert sorted((r.window_start, r.events) for r in whole) == sorted((r.window_start, r.events) for r in want)
