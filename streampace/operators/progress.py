"""Progress logs of streaming queries: one row per micro-batch, possibly reported several times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streampace.plans import chunks
from streampace.plans.quantiles import exact_quantiles

DAY_MS = 24 * 3600 * 1000

PROGRESS_SCHEMA = T.StructType([
    T.StructField("app_name", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("num_input_rows", T.LongType()),
    T.StructField("input_rows_per_second", T.DoubleType()),
    T.StructField("batch_duration_ms", T.LongType()),
    T.StructField("rows_dropped_by_watermark", T.LongType()),
    T.StructField("is_idle", T.BooleanType()),
])


def dedup_progress(progress: DataFrame, keys: Sequence[str] = ("run_id", "batch_id")) -> DataFrame:
    """The first report of each batch; idle reports, which carry the id of the batch before them, are
    one observation each by their time. Repeats are reduced before the shuffle."""
    rest = [c for c in progress.columns if c not in keys]
    first = F.min(F.struct("ts", *[c for c in rest if c != "ts"])).alias("_r")
    known = progress.dropna(subset=list(keys))
    idle = F.when(F.col("is_idle"), F.col("ts")) if "is_idle" in rest else F.lit(None).cast("timestamp")
    return known.groupBy(*keys, idle.alias("_idle_at")).agg(first).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}") for c in progress.columns])


def dedup_progress_stream(progress: DataFrame, keys: Sequence[str] = ("run_id", "batch_id"),
                          within: str = "10 minutes") -> DataFrame:
    """Streaming form: a repeat is dropped if it comes within ``within`` of event time."""
    return progress.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys))


def for_app(progress: DataFrame, name: str | None = None) -> DataFrame:
    """Rows of one application; without a name, of the one seen first."""
    if name is None:
        chosen = progress.agg(F.min(F.struct("ts", "app_name")).alias("f")).select("f.app_name")
        return progress.filter(F.col("app_name") == chosen.scalar())
    return progress.filter(F.col("app_name") == name)


def burst_flags(progress: DataFrame, threshold: int = 200) -> DataFrame:
    return progress.withColumn("is_burst", F.col("num_input_rows") > threshold)


def progress_series(progress: DataFrame) -> DataFrame:
    """Rates per run in order of time, numbered from 0; an idle report is an observation of 0.

    Chunks of the numbering are ranges of time of about a day.
    """
    seen = progress.select(
        F.col("run_id").alias("series_id"), F.unix_millis("ts").alias("_at"),
        F.coalesce("input_rows_per_second", F.lit(0.0)).alias("rate"))
    return chunks.numbered(seen, "step", step="_at", size=DAY_MS).select("series_id", "step", "rate")


def duration_summary(progress: DataFrame, mode: str = "mode") -> DataFrame:
    """Number of batches and mean, median and 95th percentile of their duration per mode."""
    return exact_quantiles(
        progress, [mode], "batch_duration_ms", {"median_ms": 0.5, "p95_ms": 0.95},
        {"batches": "rows", "mean_ms": "mean"})


def compare_modes(summary: DataFrame, baseline: str, mode: str = "mode",
                  measures: Sequence[str] = ("mean_ms", "median_ms", "p95_ms")) -> DataFrame:
    """Percentage change of each measure against the baseline mode (one row per mode)."""
    whole = Window.partitionBy(F.lit(0))

    def change(c: str):
        base = F.max(F.when(F.col(mode) == baseline, F.col(c))).over(whole)
        return ((F.col(c) / base - 1) * 100).alias(f"{c}_change_pct")

    return summary.select("*", *[change(c) for c in measures])


def late_report(progress: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Rows dropped behind the watermark per run. Spark counts them after partial aggregation, so
    this is not a count of events."""
    return progress.groupBy(*by).agg(
        F.sum("num_input_rows").alias("input_rows"),
        F.sum(F.coalesce("rows_dropped_by_watermark", F.lit(0))).alias("dropped_rows"),
        F.count_if(F.col("rows_dropped_by_watermark") > 0).alias("batches_with_drops"))


def offset_lag(latest: str, end: str):
    """Consumer lag of one source: latest minus read offsets, summed over topics and partitions.

    Both arguments name JSON columns ``{topic: {partition: offset}}``.
    """
    shape = T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType()))
    ahead, read = F.from_json(F.col(latest), shape), F.from_json(F.col(end), shape)

    def topic(_, a, b):
        gaps = F.map_values(F.map_zip_with(
            a, F.coalesce(b, F.create_map().cast("map<string,bigint>")),
            lambda _p, x, y: x - F.coalesce(y, F.lit(0))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, v: acc + v)

    sums = F.map_values(F.map_zip_with(ahead, read, topic))
    return F.aggregate(sums, F.lit(0).cast("long"), lambda acc, v: acc + v)
