"""Stored intermediate tables that survive executor loss, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
_SETTING = "spark.checkpoint.dir"
_made: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local master gets one folder for its lifetime and a cluster is an error.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {_SETTING} to a folder shared by all executors")
    if context.applicationId not in _made:
        _made[context.applicationId] = tempfile.mkdtemp(prefix="streampace-shared-")
    return _made[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path through Spark's file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before; the others may still be reachable
            continue


@contextmanager
def released() -> Iterator[list[DataFrame]]:
    """Tables stored inside are removed at the end, but for those that the block puts into the list it gets.

    What is computed inside must have been written by then, as its inputs are gone.
    """
    first, kept = len(_written), []
    yield kept
    paths = {p for df in kept for p in (os.path.dirname(f) for f in df.inputFiles())}
    inside, _written[first:] = _written[first:], []
    for spark, path in inside:
        if any(_bare(p) == _bare(path) for p in paths):
            _written.append((spark, path))
        else:
            delete(spark, path)


def _bare(path: str) -> str:
    """A path without its scheme, as readers and settings may spell it differently."""
    return "/" + path.split(":", 1)[-1].lstrip("/")


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Every later use sees the same rows, reads only the columns it needs, and depends on no executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(stored: DataFrame) -> int:
    """Size in files of a table that :func:`durable` returned."""
    return int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(stored: DataFrame, max_rows: int = BROADCAST_ROWS,
                       max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when a *stored* table is small in bytes and in rows.

    Only ``max_rows + 1`` rows are counted. Above the bounds the table is returned as it is and the
    join shuffles, with adaptive execution splitting hot keys.
    """
    if stored_bytes(stored) > max_bytes:
        return stored
    small = stored.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(stored) if small else stored
