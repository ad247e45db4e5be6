"""Progress logs: stored ones, and those of running queries."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from streampace.operators.progress import PROGRESS_SCHEMA


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS_SCHEMA).json(path)


def progress_row(app_name: str, report: dict) -> tuple:
    """One progress report, in Spark's JSON form, as a row of ``PROGRESS_SCHEMA``."""
    dropped = sum(int(op.get("numRowsDroppedByWatermark", 0))
                  for op in report.get("stateOperators", []))
    stamp = datetime.fromisoformat(report["timestamp"].replace("Z", "+00:00"))
    return (app_name, report["runId"], int(report["batchId"]), stamp.astimezone(timezone.utc),
            int(report.get("numInputRows", 0)), float(report.get("inputRowsPerSecond") or 0.0),
            int(report.get("batchDuration", 0)), dropped, False)


def progress_frame(query: StreamingQuery) -> DataFrame:
    """Recent progress of a query; Spark keeps a configured number of reports."""
    spark = SparkSession.active()
    name = spark.sparkContext.appName
    rows = [progress_row(name, json.loads(p.json)) for p in query.recentProgress]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)


class ProgressLog(StreamingQueryListener):
    """Listener that appends every progress report, idle ones as zeros, to a JSON table.

    Rows go to a folder that the driver and later jobs share, ``flush_every`` at a time, or as soon as a report comes
    ``flush_seconds`` after the first one that waits; idle queries report as well, so none waits long.
    """

    def __init__(self, spark: SparkSession, path: str, flush_every: int = 20, flush_seconds: float = 10.0) -> None:
        super().__init__()
        self._spark, self._path, self._every, self._seconds = spark, path, flush_every, flush_seconds
        self._since = 0.0
        self._app = spark.sparkContext.appName
        self._rows: list[tuple] = []
        self._last_batch: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._last_batch[str(event.runId)] = -1

    def onQueryProgress(self, event) -> None:
        report = json.loads(event.progress.json)
        self._last_batch[report["runId"]] = int(report["batchId"])
        self._add([progress_row(self._app, report)])

    def onQueryIdle(self, event) -> None:
        run = str(event.runId)
        stamp = datetime.fromisoformat(event.timestamp.replace("Z", "+00:00"))
        self._add([(self._app, run, self._last_batch.get(run, -1), stamp, 0, 0.0, 0, 0, True)])

    def onQueryTerminated(self, event) -> None:
        self._last_batch.pop(str(event.runId), None)
        self.flush()

    def _add(self, rows: Iterable[tuple]) -> None:
        if not self._rows:
            self._since = time.monotonic()
        self._rows.extend(rows)
        if len(self._rows) >= self._every or time.monotonic() - self._since >= self._seconds:
            self.flush()

    def flush(self) -> None:
        rows, self._rows = self._rows, []
        if rows:
            self._spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode(
                "append").json(self._path)
