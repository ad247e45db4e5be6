"""How the operators' inputs are derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streampace.functions.messages import epoch_seconds
from streampace.operators.series import bucket_counts, rate_series, rates_of, with_split
from streampace.plans.durable import durable, new_path
from streampace.session import load

HOUR = 3600
DAY = 24 * HOUR
TRACE_SCALE = 60.0        # an hourly count of 1 stands for 60 events per second in traces
RULE_SHAPES = ("noise", "ramp", "wall", "plateau", "cliff", "double_peak", "sawtooth")
SEGMENT_STEPS = 48
# Fixed values of the demonstration schedule: (start second, rows per second).
SCHEDULE = ((0, 50), (15, 500), (30, 50), (45, 800), (55, 300), (70, 50), (85, 1200), (95, 50),
            (110, 50))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """One series per event type, one step per hour."""
    return rate_series(events(spark, sf), ["event_type"], HOUR)


def hourly_by_user(spark: SparkSession, sf: str, hours: int = 1) -> DataFrame:
    """One series per user: many series, most of them sparse. ``hours`` is the length of a step."""
    return rate_series(events(spark, sf), ["user_id"], hours * HOUR)


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One series per order priority, one step per day."""
    return rate_series(load(spark, sf, "orders"), ["o_orderpriority"], 24 * HOUR, "o_orderdate")


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts read as a tick trace, scaled to rates at which the policies differ."""
    return hourly(spark, sf).withColumn("rate", F.col("rate") * TRACE_SCALE)


def user_ids(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").cast("string").alias("series_id")).distinct()


def split_users(spark: SparkSession, sf: str, hours: int = 1) -> DataFrame:
    """Users' series on their sides; the ids come from the counts that the series are made of."""
    counts = durable(bucket_counts(events(spark, sf), ["user_id"], hours * HOUR), "counts")
    return with_split(rates_of(counts, hours * HOUR), ids=counts)


def messages_of(table: DataFrame) -> DataFrame:
    """Events as binary JSON messages ``(value, timestamp)``; those of type ``error`` are malformed.
    Ingestion is half the event's ``value`` in milliseconds after the event."""
    body = F.to_json(F.struct(
        epoch_seconds(F.col("ts")).alias("ts"),
        F.floor("value").cast("int").alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("rate_target"),
        F.hour("ts").alias("second"),
        F.col("event_type").alias("payload"),
    ))
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("!"), body)).otherwise(body)
    return table.select(
        text.cast("binary").alias("value"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 500).cast("long"))
        .alias("timestamp"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long"))
        .alias("process_ts"))


def done_at(ts: Column, value: Column) -> Column:
    """A recorded processing time: ``value`` milliseconds after the event."""
    return F.timestamp_micros(F.unix_micros(ts) + F.round(value * 1000).cast("long"))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed events with a recorded processing time ``value`` milliseconds after the event."""
    return events(spark, sf).select(
        epoch_seconds(F.col("ts")).alias("producer_ts"),
        F.get_json_object("props", "$.k").cast("int").alias("rate_target"),
        F.hour("ts").alias("second"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 500).cast("long"))
        .alias("ingest_ts"),
        done_at(F.col("ts"), F.col("value")).alias("done_ts"))


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """A progress log: a batch per event type and hour; every batch is reported twice."""
    batches = events(spark, sf).groupBy(
        F.col("event_type").alias("run_id"),
        F.floor(F.unix_micros("ts") / 3_600_000_000).alias("batch_id"),
    ).agg(F.count(F.lit(1)).alias("num_input_rows"),
          F.round(F.sum("value")).cast("long").alias("batch_duration_ms"))
    once = batches.select(
        F.when(F.col("run_id") < "h", "front").otherwise("back").alias("app_name"),
        "run_id", "batch_id", F.timestamp_seconds((F.col("batch_id") + 1) * HOUR).alias("ts"),
        "num_input_rows", (F.col("num_input_rows") / HOUR).alias("input_rows_per_second"),
        "batch_duration_ms", F.lit(0).cast("long").alias("rows_dropped_by_watermark"))
    again = once.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
    return once.unionByName(again)


def progress_with_idle(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of a batch per user and hour, each twice, and an idle one half an hour after a batch
    that a quiet hour follows. Idle reports carry the id of the batch before them."""
    batches = events(spark, sf).groupBy(
        F.col("user_id").cast("string").alias("run_id"),
        F.floor(F.unix_micros("ts") / 3_600_000_000).alias("batch_id"),
    ).agg(F.count(F.lit(1)).alias("num_input_rows"))
    # A run's batches are numbered by hour, so the window holds one user's hours.
    following = F.lead("batch_id").over(Window.partitionBy("run_id").orderBy("batch_id"))
    once = batches.withColumn("quiet", following > F.col("batch_id") + 1).select(
        F.lit("app").alias("app_name"), "run_id", "batch_id",
        F.timestamp_seconds((F.col("batch_id") + 1) * HOUR).alias("ts"), "num_input_rows",
        (F.col("num_input_rows") / HOUR).alias("input_rows_per_second"),
        F.lit(0).cast("long").alias("batch_duration_ms"), F.lit(0).cast("long").alias("rows_dropped_by_watermark"),
        F.lit(False).alias("is_idle"), "quiet")
    again = once.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))
    idle = once.filter("quiet").withColumns({
        "ts": F.col("ts") + F.expr("INTERVAL 30 MINUTES"), "num_input_rows": F.lit(0).cast("long"),
        "input_rows_per_second": F.lit(0.0), "is_idle": F.lit(True)})
    return once.unionByName(again).unionByName(idle).drop("quiet")


def labels(series: DataFrame) -> DataFrame:
    """Segments of 48 steps that cycle over the shapes; the last third of each is left unlabelled,
    and every wall overlaps the segment after it."""
    number = F.floor(F.col("step") / SEGMENT_STEPS)
    names = F.array(*[F.lit(s) for s in RULE_SHAPES])
    starts = series.filter(F.col("step") % SEGMENT_STEPS == 0).select(
        "series_id", F.col("step").alias("start"),
        F.element_at(names, (number % len(RULE_SHAPES) + 1).cast("int")).alias("shape"))
    return starts.withColumn("end", F.col("start") + F.when(
        F.col("shape") == "wall", 60).otherwise(32))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for written results, in the folder that all executors share."""
    return new_path(spark, name)
