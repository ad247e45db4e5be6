"""Column functions of event messages: payload, event time, latency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("value", T.IntegerType()),
    T.StructField("rate_target", T.IntegerType()),
    T.StructField("second", T.IntegerType()),
    T.StructField("payload", T.StringType()),
])


def message_body(value: Column) -> Column:
    """Decode a binary message value and parse its JSON; a malformed body gives null fields."""
    return F.from_json(value.cast("string"), MESSAGE_SCHEMA)


def event_time(epoch_seconds: Column) -> Column:
    """Epoch seconds as a timestamp, cut to milliseconds."""
    return F.timestamp_millis((epoch_seconds * 1000).cast("bigint"))


def epoch_seconds(ts: Column, whole: bool = False) -> Column:
    """A timestamp as epoch seconds; ``whole=True`` drops the fraction."""
    return F.unix_timestamp(ts).cast("double") if whole else F.unix_micros(ts) / F.lit(1e6)


def latency_ms(done: Column, origin_seconds: Column, whole: bool = False) -> Column:
    """Milliseconds from ``origin_seconds`` to the timestamp ``done``."""
    return (epoch_seconds(done, whole) - origin_seconds) * 1000
