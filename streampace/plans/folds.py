"""Ordered folds over long series whose steps cannot be reordered, spread over chunks.

Three passes keep every task at one chunk of rows:

1. each chunk is summarised as a map from the state entering it to the state leaving it;
2. neighbouring maps are composed in a tree, then the states go down the tree: the left half of a node is entered
   as the node is, the right half by what the left one's map makes of that;
3. each chunk is folded from its known entering state.

No group of the tree holds more than two maps, however many chunks a series has. A series shorter than a chunk
has no maps and is folded directly. The state must be small enough to map whole: a bounded integer, or a position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streampace.plans import chunks
from streampace.plans.chunks import CHUNK, CHUNK_SIZE, KEYS
from streampace.plans.durable import durable

ChunkMap = Callable[[pd.DataFrame], tuple[Sequence[int], Sequence[int]]]
Compose = Callable[[DataFrame, Sequence[str]], DataFrame]


def image(state: Column, starts: Column, ends: Column) -> Column:
    """Image of a state under a map; states beyond either end use the outermost entry, an empty map changes nothing."""
    at = F.greatest(F.size(F.filter(starts, lambda s: s <= state)), F.lit(1))
    return F.when(F.size(starts) == 0, state).otherwise(F.element_at(ends, at))


def _both(first: tuple, second: tuple) -> tuple:
    """The map that applies ``first``, then ``second``; neighbours with equal ends are one entry."""
    (starts, ends), (starts2, ends2) = first, second
    if not len(starts) or not len(starts2):
        return second if not len(starts) else first
    out = ends2[np.maximum(np.searchsorted(starts2, ends, side="right") - 1, 0)]
    fresh = np.concatenate(([True], out[1:] != out[:-1]))
    return starts[fresh], out[fresh]


def sparse_pairs(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maps ``(*keys, node, starts, ends)`` composed by pairs of neighbours, with ``node div 2`` as their number."""
    keys = list(keys)

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("node")
        maps = [(np.asarray(s), np.asarray(e)) for s, e in zip(pair["starts"], pair["ends"], strict=True)]
        starts, ends = maps[0] if len(maps) == 1 else _both(*maps)
        return pair[[*keys, "half"]].head(1).assign(starts=[starts], ends=[ends])

    schema = ", ".join(f"{k} string" for k in keys) + ", half long, starts array<long>, ends array<long>"
    return nodes.withColumn("half", F.floor(F.col("node") / 2)).groupBy(*keys, "half").applyInPandas(
        run, schema).withColumnRenamed("half", "node")


def dense_pairs(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`sparse_pairs`, for maps whose starts are 0, 1, 2 and so on, by column functions."""
    pair = nodes.groupBy(*keys, F.floor(F.col("node") / 2).alias("half")).agg(
        F.array_sort(F.collect_list(F.struct("node", "starts", "ends"))).alias("maps"))
    first, second = F.col("maps")[0], F.element_at("maps", -1)
    ends = F.when(F.size("maps") == 1, first["ends"]).otherwise(
        F.transform(first["ends"], lambda e: F.element_at(second["ends"], F.least(e + 1, F.size(second["ends"])).cast("int"))))
    return pair.select(*keys, F.col("half").alias("node"), first["starts"].alias("starts"), ends.alias("ends"))


def chained(maps: DataFrame, keys: Sequence[str] = KEYS, pairs: Compose = sparse_pairs) -> DataFrame:
    """``(*keys, _chunk, _enter)`` for every chunk that follows another one.

    Stored ``maps(*keys, _chunk, _next, _initial, starts, ends)`` has a row for each chunk that another one follows;
    ``_initial`` is the state in which its series begins.
    """
    keys = list(keys)
    levels = [maps.select(*keys, F.col(CHUNK).alias("node"), "starts", "ends")]
    top = maps.agg(F.max(CHUNK)).first()[0]
    while top:
        levels.append(durable(pairs(levels[-1], keys), "maps"))
        top //= 2
    states = maps.groupBy(*keys).agg(F.first("_initial").alias("_enter")).withColumn("node", F.lit(0).cast("long"))
    for nodes in reversed(levels[:-1]):
        left = nodes.select(*keys, (F.col("node") + 1).alias("node"), "starts", "ends").filter("node % 2 = 1")
        parents = states.withColumnRenamed("node", "half")
        states = durable(
            nodes.select(*keys, "node", F.floor(F.col("node") / 2).alias("half")).join(parents, [*keys, "half"])
            .join(left, [*keys, "node"], "left").select(*keys, "node", F.when(
                F.col("starts").isNull(), F.col("_enter")).otherwise(
                    image(F.col("_enter"), F.col("starts"), F.col("ends"))).alias("_enter")), "states")
    here = states.withColumnRenamed("node", CHUNK)
    return maps.select(*keys, CHUNK, "_next", "starts", "ends").join(here, [*keys, CHUNK]).select(
        *keys, F.col("_next").alias(CHUNK), image(F.col("_enter"), F.col("starts"), F.col("ends")).alias("_enter"))


def entering_states(rows: DataFrame, chunk_map: ChunkMap, columns: Sequence[str],
                    keys: Sequence[str] = KEYS) -> DataFrame | None:
    """``(*keys, _chunk, _enter)`` for every chunk that follows another one, None if no series has two; chunks
    without rows are passed over, so gaps in ``step`` do no harm.

    ``rows`` carries the chunk column and the string ``keys``; column ``_initial`` is the state in
    which a series begins. ``chunk_map`` gets the rows of one chunk in step order and returns starts
    and ends: states from ``starts[i]`` up to the next start leave as ``ends[i]``; an empty map is the
    identity.
    """
    keys = list(keys)
    later = F.lead(CHUNK).over(Window.partitionBy(*keys).orderBy(CHUNK))
    held = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n")).withColumn("_next", later)
    if held.filter("_next IS NOT NULL").isEmpty():
        return None
    followed = rows.select(*keys, CHUNK, "step", "_initial", *columns).join(
        held.filter("_next IS NOT NULL").drop("_n"), [*keys, CHUNK])

    def summarise(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("step")
        starts, ends = chunk_map(part)
        head = part[[*keys, CHUNK, "_next", "_initial"]].head(1)
        return head.assign(starts=[list(starts)], ends=[list(ends)])

    ids = ", ".join(f"{k} string" for k in keys) + f", {CHUNK} long, _next long"
    maps = followed.groupBy(*keys, CHUNK).applyInPandas(
        summarise, f"{ids}, _initial long, starts array<long>, ends array<long>")
    return chained(durable(maps, "maps"), keys)


FoldBody = Callable[[pd.DataFrame, int], tuple[dict[str, Sequence], int]]


def fold_rows(rows: DataFrame, entering: DataFrame | None, body: FoldBody,
              added: Sequence[T.StructField], keys: Sequence[str] = KEYS) -> DataFrame:
    """Fold every chunk from its entering state and add the columns ``added``. Without ``entering``, every series is
    one chunk.

    ``body(run, state)`` gets consecutive rows of one chunk and the state before them, and returns
    the new columns and the state after them. Arrow batches may cut a chunk; the state goes along.
    """
    if entering is None:
        known = rows.withColumn("_state", F.col("_initial"))
    else:
        known = rows.join(entering, [*keys, CHUNK], "left").withColumn("_state", F.coalesce("_enter", "_initial"))
    placed = chunks.ordered(known, keys)
    hidden = (CHUNK, "_enter", "_initial", "_state", "_row")
    schema = T.StructType([f for f in placed.schema.fields if f.name not in hidden] + list(added))
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = 0
        for batch in batches:
            if batch.empty:
                continue
            numbers, states = batch["_row"].to_numpy(), batch["_state"].to_numpy()
            first = np.flatnonzero(numbers == 1)
            edges = [0, *first[first > 0], len(batch)]
            pieces: list[dict[str, Sequence]] = []
            for a, b in zip(edges, edges[1:]):
                if numbers[a] == 1:
                    state = int(states[a])
                columns, state = body(batch.iloc[a:b], state)
                pieces.append(columns)
            fresh = {f.name: np.concatenate([np.asarray(p[f.name]) for p in pieces])
                     for f in added}
            yield batch.assign(**fresh)[names]

    return placed.mapInPandas(run, schema)
