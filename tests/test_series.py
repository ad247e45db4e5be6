"""Series, labels, schedules and chunked plans."""

import bisect
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from streampace.operators import series
from streampace.plans import chunks, ranks

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(spark, offsets):
    rows = [(key, START + timedelta(seconds=s)) for key, values in offsets.items() for s in values]
    return spark.createDataFrame(rows, "key string, ts timestamp")


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_rate_series_covers_its_own_span(spark, by_series, size):
    df = events(spark, {"a": [0, 1, 1.5, 9.9], "b": [3, 19.2], "c": [12]})
    got = by_series(series.rate_series(df, ["key"], 1, size=size), "rate")
    assert got == {"a": [1, 2] + [0] * 7 + [1], "b": [1] + [0] * 15 + [1], "c": [1]}
    with pytest.raises(ValueError):
        series.rate_series(df, ["key"], 1, span="day")


def test_one_stray_event_makes_one_series_long(spark):
    df = events(spark, {str(i): [i] for i in range(10)} | {"old": [-400_000, 5]})
    counts = series.rate_series(df, ["key"], 1).groupBy("series_id").count().collect()
    assert {r["count"] for r in counts} == {1, 400_006}


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_rate_series_has_zeros_and_common_span_on_request(spark, by_series, size):
    df = events(spark, {"a": [0, 1, 1.5, 9.9], "b": [3, 19.2], "c": [12]})
    got = by_series(series.rate_series(df, ["key"], 1, size=size, span="table"), "rate")
    assert {k: len(v) for k, v in got.items()} == {"a": 20, "b": 20, "c": 20}
    assert got["a"] == [1, 2] + [0] * 7 + [1] + [0] * 10
    assert [i for i, r in enumerate(got["b"]) if r] == [3, 19]
    assert got["c"][12] == 1 and sum(got["c"]) == 1


def test_rate_series_units_and_composite_keys(spark, by_series):
    df = events(spark, {"a": [0, 1, 2, 61]}).withColumn("n", F.lit(7))
    got = by_series(series.rate_series(df, ["key", "n"], 60, unit_seconds=1), "rate")
    assert got == {"a|7": [3 / 60, 1 / 60]}


def test_reindex_makes_dense_steps(spark, by_series):
    rows = [("a", 10 * i) for i in range(25)] + [("b", 7)]
    df = spark.createDataFrame(rows, "series_id string, at long")
    got = by_series(series.reindexed(df, "at", size=40), "step", "at")
    assert got == {"a": list(range(25)), "b": [0]}


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_neighbours_and_regimes(make_series, by_series, size):
    rates = {"a": [10, 100, 260, 255, 150, 149, 500]}
    df = make_series(rates)
    assert by_series(series.with_previous(df, size=size), "previous")["a"] == [
        None, 10, 100, 260, 255, 150, 149]
    assert by_series(series.with_next(df, size=size), "actual")["a"] == [
        100, 260, 255, 150, 149, 500, None]
    tags = by_series(series.with_regime(df, size=size), "regimes")["a"]
    assert tags[0] == ["all"] and tags[2] == ["all", "burst", "transition"]
    assert tags[3] == ["all", "burst"] and tags[4] == ["all", "transition"]


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_labels(spark, make_series, by_series, size):
    df = make_series({"a": [1] * 15, "b": [1] * 3})
    labels = spark.createDataFrame(
        [("a", 2, 6, "wall"), ("a", 4, 8, "cliff"), ("a", 12, 99, "ramp"), ("a", 9, 9, "never"),
         ("z", 0, 5, "other")], "series_id string, start long, end long, shape string")
    got = by_series(series.label_steps(df, labels, size=size), "shape")
    assert got["a"] == (["noise"] * 2 + ["wall"] * 2 + ["cliff"] * 4 + ["noise"] * 4 + ["ramp"] * 3)
    assert got["b"] == ["noise"] * 3


SCHEDULE = [(0, 50), (15, 500), (30, 50), (45, 800), (55, 300), (70, 50), (85, 1200), (95, 50),
            (110, 50)]


@pytest.mark.parametrize("as_table", [False, True])
def test_schedule(spark, as_table):
    ticks = spark.createDataFrame([(-1.0,), (0.0,), (14.9,), (15.0,), (44.0,), (90.0,), (200.0,)],
                                  "elapsed double")
    schedule = SCHEDULE
    if as_table:
        schedule = spark.createDataFrame(SCHEDULE, "start long, target long")
    got = {r["elapsed"]: r["rate_target"] for r in series.asof_schedule(
        ticks, schedule).collect()}
    assert got == {-1.0: 50, 0.0: 50, 14.9: 50, 15.0: 500, 44.0: 50, 90.0: 1200, 200.0: 50}


@pytest.mark.parametrize("size", [2, 1 << 16])
def test_cap_keeps_shape(make_series, by_series, size):
    df = make_series({"a": [100, 4000, 2000, 1000, 0], "b": [5, 10], "z": [0, 0]})
    got = by_series(series.cap_series(df, 2000.0, size=size), "rate")
    assert got == {"a": [50, 2000, 1000, 500, 0], "b": [5, 10], "z": [0, 0]}
    assert by_series(series.floor_rate(df), "rate")["z"] == [1, 1]


def test_split_is_by_whole_series_and_ordered(spark, make_series):
    df = make_series({f"s{i:03d}": [1, 2] for i in range(20)})
    rows = series.with_split(df).select("series_id", "split").distinct().collect()
    assert len(rows) == 20       # no series on two sides
    order = [r["split"] for r in sorted(rows)]
    assert order == ["train"] * 14 + ["val"] * 3 + ["test"] * 3


def test_dense_index(spark):
    values = [f"{random.Random(i).random():.6f}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values + values[:50]], "v string")
    got = {r["v"]: r["rank"] for r in ranks.dense_index(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values)))}


def test_summary_and_recent(make_series):
    df = make_series({"a": [4, 1, 3, 2], "b": [7]})
    got = {r["series_id"]: r for r in series.rate_summary(df).collect()}
    assert (got["a"]["min"], got["a"]["max"], got["a"]["mean"]) == (1, 4, 2.5)
    assert (got["a"]["p25"], got["a"]["p75"]) == (1.75, 3.25)
    whole = series.rate_summary(df, by=()).collect()[0]
    assert (whole["min"], whole["max"], whole["p25"]) == (1, 7, 2.0)
    kept = series.recent(df, 2).collect()
    assert sorted((r["series_id"], r["step"]) for r in kept) == [("a", 2), ("a", 3), ("b", 0)]


def test_halo_must_fit(make_series):
    with pytest.raises(ValueError):
        chunks.with_halo(make_series({"a": [1]}), before=5, size=4)


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_overlapping_labels_equal_a_loop(spark, make_series, by_series, size):
    rng = random.Random(size)
    df = make_series({"a": [1] * 100, "b": [1] * 40})
    rows = []
    for _ in range(60):
        start = rng.randrange(-5, 110)
        rows.append((rng.choice("abz"), start, start + rng.choice([0, 1, 3, 10, 200]), rng.choice(["wall", "ramp", "cliff"])))
    rows.append(("a", 50, 60, None))
    labels = spark.createDataFrame(rows, "series_id string, start long, end long, shape string")
    got = by_series(series.label_steps(df, labels, size=size), "shape")
    for s, n in (("a", 100), ("b", 40)):
        want = [max(((a, shape) for i, a, b, shape in rows if i == s and shape and a <= t < b), default=(0, "noise"))[1]
                for t in range(n)]
        assert got[s] == want


def test_schedule_with_a_hot_time_and_many_entries(spark):
    """A third of all ticks have one time, and most ranges of time hold no entry."""
    rng = random.Random(2)
    times = [5.0] * 2000 + [rng.uniform(-10, 1000) for _ in range(4000)] + [None]
    entries = sorted({round(rng.uniform(0, 900), 2) for _ in range(50)} | {5.0})
    ticks = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, elapsed double")
    schedule = spark.createDataFrame([(e, i) for i, e in enumerate(entries)], "start double, target int")
    found = series.asof_schedule(ticks, schedule, parts=9)
    got = {r.id: r.rate_target for r in found.collect()}
    assert got == {i: max(bisect.bisect_right(entries, t) - 1, 0) if t is not None else 0 for i, t in enumerate(times)}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "ranges-" in text and "NestedLoop" not in text
    held = [r["count"] for r in spark.read.parquet(re.search(r"file:(\S*ranges-[0-9a-f]+)", text)[1]).groupBy("_range").count().collect()]
    assert len(held) == 9 and max(held) < 2 * sum(held) / 9


def test_sides_of_many_series_equal_those_of_few(spark, make_series, monkeypatch):
    df = make_series({f"s{i:03d}": [1, 2] for i in range(41)})
    few = sorted(map(tuple, series.with_split(df, 0.5, 0.3).select("series_id", "step", "split").collect()))
    monkeypatch.setattr(series, "BROADCAST_ROWS", 3)
    many = series.with_split(df, 0.5, 0.3)
    assert sorted(map(tuple, many.select("series_id", "step", "split").collect())) == few
    count = {s: sum(r[2] == s for r in few) for s in ("train", "val", "test")}
    assert count == {"train": 40, "val": 24, "test": 18}
