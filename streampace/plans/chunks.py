"""Chunked layout: ordered work on one long series, spread over many tasks.

A series table has rows ``(series_id, step, ...)`` with ``step`` dense (no gaps) per series. A window
partitioned by ``series_id`` alone puts a hot series into one task. Here the partition key is always
``(series_id, chunk)`` with ``chunk = step div size``:

* frames that look at most ``before`` rows back and ``after`` rows ahead get those rows copied into the
  neighbouring chunk (the halo) and are dropped again by :func:`trim`;
* running totals are split in a part inside the chunk and a carry over the chunk summaries, of which
  a series has only ``length / size``.

Both sides of the joins made here are keyed by ``(series_id, chunk)``, so no key holds more than
``size`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_SIZE = 1 << 16
CHUNK = "_chunk"
KEYS = ("series_id",)


def chunk_of(step: str | Column, size: int = CHUNK_SIZE) -> Column:
    col = F.col(step) if isinstance(step, str) else step
    return F.floor(col / F.lit(size))


def with_chunk(df: DataFrame, size: int = CHUNK_SIZE, step: str = "step") -> DataFrame:
    return df.withColumn(CHUNK, chunk_of(step, size))


def with_halo(df: DataFrame, before: int = 0, after: int = 0, size: int = CHUNK_SIZE,
              step: str = "step") -> DataFrame:
    """Add the chunk column, copying boundary rows into the neighbour that needs them."""
    if max(before, after) > size:
        raise ValueError(f"halo of {max(before, after)} rows exceeds the chunk size {size}")
    home = chunk_of(step, size)
    place = F.col(step) - home * size
    homes = [home]
    if before:
        homes.append(F.when(place >= size - before, home + 1))
    if after:
        homes.append(F.when(place < after, home - 1))
    if len(homes) == 1:
        return df.withColumn(CHUNK, home)
    return df.withColumn(CHUNK, F.explode(F.array_compact(F.array(*homes))))


def trim(df: DataFrame, size: int = CHUNK_SIZE, step: str = "step",
         keep_chunk: bool = False) -> DataFrame:
    """Drop halo copies; rows stay where they are."""
    own = df.filter(F.col(CHUNK) == chunk_of(step, size))
    return own if keep_chunk else own.drop(CHUNK)


def in_chunk(keys: Sequence[str] = KEYS, step: str = "step") -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(step)


def up_to_here(keys: Sequence[str] = KEYS, step: str = "step") -> WindowSpec:
    return in_chunk(keys, step).rowsBetween(Window.unboundedPreceding, 0)


def attach_carry(df: DataFrame, parts: Mapping[str, Column],
                 carry: Callable[[WindowSpec, WindowSpec], Mapping[str, Column]],
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Join values computed over the chunk summaries of each series back to the rows.

    ``parts`` aggregates one chunk; ``carry(before, whole)`` builds the attached columns from the part
    columns with a window over the preceding chunks and one over all chunks of the series.
    """
    by_series = Window.partitionBy(*keys)
    before = by_series.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*keys, CHUNK).agg(*[agg.alias(name) for name, agg in parts.items()])
    carried = summary.select(
        *keys, CHUNK, *[col.alias(name) for name, col in carry(before, by_series).items()]
    )
    return df.join(carried, [*keys, CHUNK])


def ordered(df: DataFrame, keys: Sequence[str] = KEYS, step: str = "step") -> DataFrame:
    """Cluster rows by (keys, chunk) and sort by step, for a map over partitions that follows."""
    return df.withColumn("_row", F.row_number().over(in_chunk(keys, step)))


def numbered(df: DataFrame, out: str, keys: Sequence[str] = KEYS, step: str = "step",
             size: int = CHUNK_SIZE) -> DataFrame:
    """Consecutive numbers from 0 per series in ``step`` order; ``step`` may have gaps here."""
    placed = attach_carry(
        with_chunk(df, size, step),
        {"_n": F.count(F.lit(1))},
        lambda before, _: {"_offset": F.coalesce(F.sum("_n").over(before), F.lit(0))},
        keys,
    )
    here = F.row_number().over(in_chunk(keys, step))
    return placed.withColumn(out, F.col("_offset") + here - 1).drop("_offset", CHUNK)
