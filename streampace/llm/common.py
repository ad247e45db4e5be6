"""Helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streampace.plans.durable import durable
from streampace.session import ship

HOT_KEYS = 1000
BATCH_BYTES = 4 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROWS_OF_TEXT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, with small Arrow batches as its rows hold whole texts."""
    ship(spark)
    if int(spark.conf.get(_BATCH_ROWS)) > _ROWS_OF_TEXT:
        spark.conf.set(_BATCH_ROWS, str(_ROWS_OF_TEXT))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, which names each row and is the same in every evaluation.

    Rows of files are named by file and position; other tables are stored first, as what computes them
    may order its rows differently the next time.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return docs.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("_row"))
    return durable(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")


def aside(docs: DataFrame, inner: Sequence[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns called like one of the ``inner`` names under other names, and the way back."""
    names = {c.lower() for c in docs.columns}
    other = {}
    for c in docs.columns:
        if c.lower() in {i.lower() for i in inner}:
            fresh = f"{c}_aside"
            while fresh.lower() in names:
                fresh += "_"
            names.add(fresh.lower())
            other[c] = fresh
    if not other:
        return docs, lambda found: found
    return docs.withColumnsRenamed(other), lambda found: found.withColumnsRenamed({fresh: c for c, fresh in other.items()})


def fold_of(key: str, folds: int) -> Column:
    """crc32 of a key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of ``column``; a longer value stands
    alone."""
    start, size = 0, 0
    for i, value in enumerate(batch.column(column)):
        n = len(value.as_buffer()) if value.is_valid else 0
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """Inner join of rows with a table that has one row per key.

    ``weight`` is the number of left rows of the key. Keys with more than a thousandth of all rows,
    of which there are fewer than a thousand, are broadcast; the others are shuffled, so no task gets
    more than a thousandth of the rows for one key. Both inputs are read twice and should be stored.
    Null keys match nothing.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    most = max(total // HOT_KEYS, 1)
    hot = F.broadcast(right.filter(F.col(weight) > most).drop(weight))
    cold = right.filter(F.col(weight) <= most).drop(weight)
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key)
    return left.join(hot, key).unionByName(rest)


def running_start(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str],
                  tie: Sequence[str] = (), per_bucket: int = 20_000) -> DataFrame:
    """For each ``out: n`` of ``sums`` a column ``out``: the sum of ``n`` over earlier rows of ``by``.

    The order is by a hash of ``order``, then by ``order`` and ``tie``. A bucket is a range of hashes with
    about ``per_bucket`` rows, so no window holds a whole group; the sums of the buckets are a small
    table that is joined on the key of the window. ``rows`` is read three times and should be stored.
    """
    bits = max(1, (rows.count() // per_bucket).bit_length())
    hashed = rows.withColumn("_h", F.xxhash64(*order)).withColumn(
        "_bucket", F.shiftrightunsigned("_h", 64 - bits))
    keys = [*by, "_bucket"]
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = hashed.groupBy(*keys).agg(*[F.sum(n).alias(f"_sum_{out}") for out, n in sums.items()]).select(
        *keys, *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_base_{out}") for out in sums])
    inside = Window.partitionBy(*keys).orderBy("_h", *order, *tie).rowsBetween(
        Window.unboundedPreceding, -1)
    return hashed.join(base, keys).withColumns(
        {out: F.col(f"_base_{out}") + F.coalesce(F.sum(n).over(inside), F.lit(0)) for out, n in sums.items()}
    ).drop("_h", "_bucket", *[f"_base_{out}" for out in sums])
