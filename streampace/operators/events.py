"""Event messages: parsing, latency rows and windowed counts. All work on batches and on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streampace.functions import messages as fm
from streampace.plans.quantiles import SMALL_GROUP, exact_quantiles

SKETCH_K = 2048      # a sketch of up to about so many values is exact; beyond, ranks are off by some 1.7 / k

PERCENTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def parse_messages(raw: DataFrame, value: str = "value", ingest: str = "timestamp") -> DataFrame:
    """Binary JSON messages as flat columns, with the broker's ingest time and the event time.

    Columns: ``producer_ts, value, rate_target, second, payload, ingest_ts, event_time``.
    """
    body = raw.select(fm.message_body(F.col(value)).alias("m"), F.col(ingest).alias("ingest_ts"))
    return body.select(
        F.col("m.ts").alias("producer_ts"), "m.value", "m.rate_target", "m.second", "m.payload",
        "ingest_ts", fm.event_time(F.col("m.ts")).alias("event_time"))


def event_table(raw: DataFrame, watermark: str = "5 seconds") -> DataFrame:
    """Parsed messages as an event-time table that tolerates events late by ``watermark``."""
    return parse_messages(raw).withWatermark("event_time", watermark)


def with_latency(parsed: DataFrame, process: Column | None = None,
                 truncate_seconds: bool = False) -> DataFrame:
    """Add ``process_ts``, ``e2e_latency_ms`` and ``kafka_latency_ms``.

    ``process`` defaults to the batch's current time. ``truncate_seconds`` uses whole seconds, which
    biases values by up to a second and can make them negative.
    """
    done = F.current_timestamp() if process is None else process
    return parsed.withColumn("process_ts", done).withColumns({
        "e2e_latency_ms": fm.latency_ms(
            F.col("process_ts"), F.col("producer_ts"), truncate_seconds),
        "kafka_latency_ms": fm.latency_ms(
            F.col("process_ts"), fm.epoch_seconds(F.col("ingest_ts"), truncate_seconds),
            truncate_seconds),
    })


def latency_rows(latencies: DataFrame) -> DataFrame:
    """The columns that are written out per event."""
    return latencies.select(
        "producer_ts", "rate_target", "second", "e2e_latency_ms", "kafka_latency_ms")


def latency_stats(latencies: DataFrame, by: Sequence[str] = ("rate_target",),
                  exact: bool = True, small_group: int = SMALL_GROUP) -> DataFrame:
    """Count, mean and p50/p95/p99 latency per group.

    ``exact=False`` uses sketches and so also runs on streams, in complete or update mode.
    """
    if exact:
        return exact_quantiles(latencies, list(by), "e2e_latency_ms", PERCENTILES,
                               {"events": "rows", "avg_latency_ms": "mean"}, small_group)
    return latencies.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.avg("e2e_latency_ms").alias("avg_latency_ms"),
        *[F.percentile_approx("e2e_latency_ms", p).alias(name) for name, p in PERCENTILES.items()])


def latency_sketches(latencies: DataFrame, window: str, by: Sequence[str] = ("rate_target",), ts: str = "event_time",
                     watermark: str | None = None, k: int = SKETCH_K) -> DataFrame:
    """``window_start, window_end, *by, events, total_ms, sketch`` per tumbling window; runs on streams, in any mode.

    Sketches are bounded in size and can be merged over any range of windows and groups, so running statistics
    are kept by storing one row per window instead of the latencies.
    """
    timed = latencies.withWatermark(ts, watermark) if watermark else latencies
    value = F.col("e2e_latency_ms")
    found = timed.groupBy(F.window(ts, window).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("events"), F.count(value).alias("measured"), F.sum(value).alias("total_ms"),
        F.kll_sketch_agg_double(value, k).alias("sketch"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events",
                        "measured", "total_ms", "sketch")


def merged_latency(sketches: DataFrame, by: Sequence[str] = ("rate_target",), start: str | None = None,
                   end: str | None = None, k: int = SKETCH_K) -> DataFrame:
    """Count, mean and p50/p95/p99 per group from :func:`latency_sketches`, over the windows from ``start`` to ``end``.

    A percentile is the smallest value that covers the share; null where nothing was measured.
    """
    chosen = sketches
    if start is not None:
        chosen = chosen.filter(F.col("window_start") >= F.lit(start).cast("timestamp"))
    if end is not None:
        chosen = chosen.filter(F.col("window_end") <= F.lit(end).cast("timestamp"))
    merged = chosen.groupBy(*by).agg(
        F.sum("events").alias("events"), F.sum("measured").alias("_measured"), F.sum("total_ms").alias("_total"),
        F.kll_merge_agg_double(F.when(F.col("measured") > 0, F.col("sketch")), k).alias("_sketch"))
    some = F.col("_measured") > 0
    return merged.select(*by, "events", F.when(some, F.col("_total") / F.col("_measured")).alias("avg_latency_ms"), *[
        F.when(some, F.kll_sketch_get_quantile_double("_sketch", F.lit(p))).alias(name) for name, p in PERCENTILES.items()])


def latency_distribution(latencies: DataFrame, by: Sequence[str] = ("rate_target",),
                         width_ms: float = 1.0) -> DataFrame:
    """Cumulative share of events per latency bin: equal latencies are counted before any ordering."""
    bins = latencies.groupBy(*by, (F.floor(F.col("e2e_latency_ms") / width_ms) * width_ms)
                             .alias("latency_ms")).agg(F.count(F.lit(1)).alias("events"))
    whole = Window.partitionBy(*by)
    running = whole.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn(
        "cumulative", F.sum("events").over(running) / F.sum("events").over(whole))


def windowed_count(events: DataFrame, size: str, ts: str = "timestamp",
                   watermark: str | None = None) -> DataFrame:
    """Events per tumbling window: ``window_start, window_end, events``."""
    timed = events.withWatermark(ts, watermark) if watermark else events
    counted = timed.groupBy(F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("window_start"),
                          F.col("w.end").alias("window_end"), "events")


def windowed_stats(events: DataFrame, size: str, value: str = "rate_target",
                   ts: str = "event_time", watermark: str | None = "5 seconds") -> DataFrame:
    """Count and mean of ``value`` per tumbling window."""
    timed = events.withWatermark(ts, watermark) if watermark else events
    stats = timed.groupBy(F.window(ts, size).alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(F.col(value).cast("double")).alias(f"avg_{value}"))
    return stats.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                        "event_count", f"avg_{value}")


def count_by(events: DataFrame, *columns: str) -> DataFrame:
    return events.groupBy(*columns).agg(F.count(F.lit(1)).alias("events"))


def events_per_mode(results: DataFrame, path: str = "path") -> DataFrame:
    """Rows per result directory; the mode is the directory that holds the file, with or without a
    leading ``mode=``."""
    mode = F.regexp_extract(F.col(path), r"([^/=]+)/[^/]+$", 1)
    return results.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("events"))
