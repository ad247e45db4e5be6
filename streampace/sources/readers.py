"""Event sources: thin builders around Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATENCY_SCHEMA = T.StructType([
    T.StructField("producer_ts", T.DoubleType()),
    T.StructField("rate_target", T.IntegerType()),
    T.StructField("second", T.IntegerType()),
    T.StructField("e2e_latency_ms", T.DoubleType()),
    T.StructField("kafka_latency_ms", T.DoubleType()),
])


def read_rate(spark: SparkSession, rows_per_second: int = 100, ramp_up: str | None = None,
              per_batch: int | None = None) -> DataFrame:
    """Generated ``(timestamp, value)`` rows. ``per_batch`` selects the deterministic variant with a
    fixed number of rows per micro-batch."""
    if per_batch is not None:
        return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).load()
    reader = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second)
    if ramp_up:
        reader = reader.option("rampUpTime", ramp_up)
    return reader.load()


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """One ``value`` row per text line of a TCP connection (for trials; not fault-tolerant)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def kafka_options(servers: str, topic: str, starting: str = "latest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}


def read_kafka(spark: SparkSession, servers: str, topic: str, starting: str = "latest",
               max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Stream of one topic; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, topic, starting))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load()


def read_kafka_batch(spark: SparkSession, servers: str, topic: str,
                     starting: str = "earliest") -> DataFrame:
    return spark.read.format("kafka").options(**kafka_options(servers, topic, starting)).load()


def replay_events(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  max_files_per_trigger: int | None = 1, fmt: str = "parquet") -> DataFrame:
    """Stream a recorded table. Without a schema, that of the stored table is used.

    Read file by file, files should be written in time order, otherwise a watermark drops rows.
    ``max_files_per_trigger=None`` reads all that is new at each trigger; if another streaming query
    writes the table, these are whole batches of it.
    """
    stored = schema or spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(stored)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def read_results(spark: SparkSession, root: str, schema: T.StructType = LATENCY_SCHEMA) -> DataFrame:
    """JSON results of all modes under ``root/<mode>/`` with the file they came from as ``path``."""
    return spark.read.schema(schema).json(f"{root}/*").withColumn(
        "path", F.col("_metadata.file_path"))
