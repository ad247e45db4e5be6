"""Replay of a recorded table in the order of its event times, whatever files hold it.

Offsets of the stream are event times: each micro-batch takes the rows of one more slice of time, read from the
files whose times touch it. A first job of Spark finds the times that each file holds; within a file, row groups
outside the slice are skipped by their statistics, so tables written in time order are read once. A replay
continues from its checkpoint like any stream, also in the middle of a recording.

After the last row a closing mark moves the watermark past the recording, so the last windows close as well. Files are
read by pyarrow in the tasks: local folders and the stores that pyarrow knows (s3, gs, hdfs).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from streampace.plans.durable import new_path
from streampace.session import ship, zoned
from streampace.sources.readers import replay_events

# The process that plans a stream is neither the driver nor a worker with the package: the classes go along whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Slice(InputPartition):
    """Rows of one file with ``start <= time < end`` in microseconds; without a file, the closing mark at ``start``."""

    path: str | None
    start: int
    end: int


class RecordedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.ts, self.schema = options["ts"], schema
        self.files: list[list] = json.loads(options["files"])           # path, first time, last time
        self.first, self.last = int(options["first"]), int(options["last"])
        self.step, self.closing = int(options["step"]), int(options["closing"])
        self.done = self.first

    def initialOffset(self) -> dict:
        return {"us": self.first}

    def latestOffset(self) -> dict:
        return {"us": max(self.done, min(self.done + self.step, self.last + 1))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        lo, hi = start["us"], end["us"]
        self.done = max(self.done, hi)
        found: list[InputPartition] = [Slice(path, lo, hi) for path, first, last in self.files if first < hi and last >= lo]
        if self.closing and lo <= self.last < hi:
            found.append(Slice(None, self.last + self.closing, 0))
        return found

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        if partition.path is None:
            mark = [pa.array([partition.start if f.name == self.ts else None], pa.int64() if f.name == self.ts else f.type)
                    for f in wanted]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(mark, wanted, strict=True)], schema=wanted)
            return
        store, path = fs.FileSystem.from_uri(partition.path)
        table = ds.dataset(path, filesystem=store, format="parquet")
        kind = table.schema.field(self.ts).type
        at = [pa.scalar(us, pa.int64()).cast(pa.timestamp("us", kind.tz)).cast(kind) for us in (partition.start, partition.end)]
        rows = table.scanner(columns=wanted.names, filter=(ds.field(self.ts) >= at[0]) & (ds.field(self.ts) < at[1]))
        for batch in rows.to_batches():
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f.name).cast(f.type) for f in wanted], schema=wanted)


class RecordedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def streamReader(self, schema: StructType) -> RecordedReader:
        return RecordedReader(self.options, schema)


def replay_by_time(spark: SparkSession, path: str, ts: str = "ts", watermark: str | None = "0 seconds",
                   slice_seconds: float | None = None, closing_seconds: float | None = 3600.0,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Stream the rows of the parquet table at ``path`` slice by slice, with a watermark on ``ts``.

    ``slice_seconds=None`` takes the whole recording in one micro-batch. ``closing_seconds`` is how far beyond the last row the
    closing mark lies: at least the watermark's delay and one window; None leaves the last windows open. The mark
    is filtered behind the watermark and never seen. ``watermark=None`` sets none, and then there is no mark. Rows without a
    time are left out.
    """
    ship(spark)
    stored = spark.read.parquet(path)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    files = [list(r) for r in stored.filter(F.col(ts).isNotNull()).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min(micros), F.max(micros)).orderBy("path").collect()]
    first, last = min((f[1] for f in files), default=0), max((f[2] for f in files), default=-1)
    step = last + 1 - first if slice_seconds is None else max(1, round(slice_seconds * 1_000_000))
    schema = stored.select(*(columns or stored.columns)).schema
    for field in schema.fields:
        field.nullable = True
    spark.dataSource.register(RecordedSource)
    options = {"schema": schema.json(), "files": json.dumps(files), "ts": ts, "first": first, "last": last,
               "step": max(step, 1), "closing": round(closing_seconds * 1_000_000) if files and watermark and closing_seconds else 0}
    rows = zoned(spark.readStream.format("recorded").options(**{k: str(v) for k, v in options.items()}).load())
    if watermark is None:
        return rows
    # The filter names the event time, so it stays behind the watermark.
    return rows.withWatermark(ts, watermark).filter(F.unix_micros(ts) <= last)


def replay_whole(spark: SparkSession, path: str, ts: str = "ts", watermark: str = "0 seconds",
                 closing_seconds: float = 3600.0, columns: Sequence[str] | None = None) -> DataFrame:
    """Stream the parquet table at ``path`` (a folder or a pattern) in one micro-batch, closed as by :func:`replay_by_time`.

    Spark's own file source reads the table, so it may lie in any store; no row is late, as all come at once. The mark
    is a file of one row in the shared folder, read beside the table.
    """
    ship(spark)
    stored = zoned(spark.read.parquet(path)).select(*(columns or ["*"]))
    last = stored.agg(F.max(F.unix_micros(ts))).first()[0] or 0
    mark = new_path(spark, "mark")
    spark.range(1, numPartitions=1).select(*[
        F.timestamp_micros(F.lit(last + round(closing_seconds * 1_000_000))).alias(ts) if f.name == ts
        else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema.fields]).write.parquet(mark)
    rows = zoned(replay_events(spark, path, max_files_per_trigger=None)).select(*(columns or ["*"]))
    both = rows.unionByName(replay_events(spark, mark, stored.schema, max_files_per_trigger=None))
    return both.withWatermark(ts, watermark).filter(F.unix_micros(ts) <= last)


def drain(query: StreamingQuery) -> StreamingQuery:
    """Let a query over recordings take all slices, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
