"""Near duplicates by SimHash fingerprints and a generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits, each with a threshold of its own. If the
thresholds plus one add up to the distance plus one, fingerprints within the distance agree up to the
threshold in some partition; a partition with threshold -1 is never probed. How many partitions there
are, and their thresholds, is chosen by dynamic programming on the candidates and probes expected from
the bits' statistics over all fingerprints, so larger tables get wider partitions. Candidates of a
bucket are verified on all bits. In a bucket with more fingerprints than there are values within half the
distance of one, no pairs are made: there all fingerprints are written under each of these values, and
those that meet under one are linked to the smallest, which links exactly the same fingerprints in
linear work.

The search runs on distinct fingerprints, so copies cost nothing. Null and empty texts have fingerprint
zero and are linked like others. Null ids count as the largest; a component of null ids has a null
component. Repeated rows come back one by one, an empty table gives an empty result. Texts of any length are read
whole. Other columns may have any names; those called like a column of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from streampace.llm.common import aside, lookup, with_row
from streampace.llm.components import components
from streampace.llm.exact_dedup import normalised
from streampace.plans.durable import broadcast_if_small, durable

BITS = 64
SEED = 42
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words; of all words if there are fewer; none if there is none."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(islice(words, i, None) for i in range(width)), strict=False))
    return np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64)


def fingerprints(hashes: list[np.ndarray]) -> np.ndarray:
    """Per text the bits set in over half of its hashes, as signed 64-bit numbers."""
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero([len(h) for h in hashes])
    if not len(some):
        return out.view(np.int64)
    sizes = np.array([len(hashes[i]) for i in some])
    h = np.concatenate([hashes[i] for i in some])
    ends = np.cumsum(sizes)
    # Eight bits are counted side by side in the bytes of a word, so a run is cut every 255 hashes.
    cuts = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(cuts)[:-1]])
    inner = np.arange(cuts.sum()) - np.repeat(first, cuts)
    starts = np.repeat(ends - sizes, cuts) + 255 * inner
    counts = np.zeros((len(some), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        counts[:, :, k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
    bits = counts.reshape(len(some), BITS) * 2 > sizes[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def with_fingerprints(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and ``print``, the fingerprint as a long."""
    kept = [c for c in docs.columns if c not in (text, "print")]
    schema = docs.select(*kept).schema.add("print", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in normalised(batches):
            found = fingerprints([shingle_hashes(t, width) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(found)], names=[*kept, "print"])

    return docs.select(*kept, text).mapInArrow(run, schema)


# ---- how the bits are searched ------------------------------------------------------------------

def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both of two bits (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little").astype(np.float32)
            total += bits.T @ bits
            rows += len(bits)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), rows).astype(np.int64))],
                names=["cell", "n"])

    cells = prints.select("print").mapInArrow(run, "cell long, n long").groupBy("cell").agg(
        F.sum("n").alias("n")).collect()
    counts = np.zeros(BITS * BITS + 1)
    for cell, n in cells:
        counts[cell] = n
    return int(counts[-1]), counts[:-1].reshape(BITS, BITS)


def partitions(total: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of bits; each grows from its strongest pair by the bit most correlated with it."""
    p = np.diag(both) / max(total, 1)
    cov = both / max(total, 1) - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    left, out = list(range(BITS)), []
    for i in range(m):
        size = len(left) // (m - i)
        inside = strength[np.ix_(left, left)]
        group = [left[int(inside.sum(1).argmax())]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(strength[np.ix_(group, rest)].sum(0).argmax())])
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def _within(p: np.ndarray, bits: list[int], t: int) -> float:
    """Chance that two fingerprints differ in at most ``t`` of these bits, from the bits' frequencies."""
    chance = np.zeros(t + 2)
    chance[0] = 1.0
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - differ) + chance[:-1] * differ
        chance[0] *= 1 - differ
    return float(chance[:t + 1].sum())


def allocate(total: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds: the cheapest by expected candidates and probes."""
    p = np.diag(both) / max(total, 1)
    best = (float("inf"), [])
    for m in range(1, distance + 2):
        groups = partitions(total, both, m)
        # cheapest[s]: for the groups so far, thresholds plus one add up to s
        cheapest: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            after: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, chosen) in cheapest.items():
                for t in range(-1, distance - s + 1):
                    keys = sum(comb(len(bits), d) for d in range(t + 1))
                    more = cost + keys + (total * _within(p, bits, t) if t >= 0 else 0.0)
                    if s + t + 1 not in after or more < after[s + t + 1][0]:
                        after[s + t + 1] = (more, [*chosen, t])
            cheapest = after
        cost, chosen = cheapest[distance + 1]
        if cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


# ---- probing ------------------------------------------------------------------------------------

def _signed(bits: tuple[int, ...] | list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], radius: int) -> Column:
    """Array of masks that flip at most ``radius`` of the bits."""
    return F.array(*[F.lit(_signed(c)).cast("long") for d in range(radius + 1) for c in combinations(bits, d)])


def links(prints: DataFrame, distance: int, bucket: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between distinct stored fingerprints that connect all within ``distance``.

    ``distance`` is even. Every link is within the distance; of a crowded bucket only enough links are
    made to connect the same fingerprints.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    if bucket is None:
        bucket = sum(comb(BITS, d) for d in range(distance // 2 + 1))
    total, both = bit_counts(prints)
    plan = allocate(total, both, distance)
    index, probes = [], []
    for i, (bits, t) in enumerate(plan):
        key = F.col("print").bitwiseAND(F.lit(_signed(bits)).cast("long"))
        index.append(prints.select(F.lit(i).alias("part"), key.alias("key"), "print"))
        if t:
            probes.append(index[-1].select(
                "part", F.explode(F.transform(_flips(bits, t), lambda f: F.col("key").bitwiseXOR(f))).alias("key"),
                "print"))
    indexed = index[0]
    for part in index[1:]:
        indexed = indexed.unionByName(part)
    sizes = durable(indexed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")), "buckets")
    # A bucket of one is only of use where others probe it.
    lone = [i for i, (_, t) in enumerate(plan) if t == 0]
    useful = sizes.filter((F.col("n") > 1) | ~F.col("part").isin(lone)).withColumn("size", F.col("n"))
    members = durable(lookup(indexed, useful, ["part", "key"], "n"), "members")
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= distance
    some = members.filter(F.col("size") <= bucket).select(
        F.col("part").alias("in_part"), F.col("key").alias("in_key"), F.col("print").alias("other"))
    same = (F.col("part") == F.col("in_part")) & (F.col("key") == F.col("in_key"))
    asking = members.filter(F.col("size") <= bucket).filter(F.col("part").isin(lone)).select("part", "key", "print")
    pairs = asking.join(some, same & (F.col("print") < F.col("other")) & near).select("print", "other")
    for probe in probes:
        pairs = pairs.unionByName(probe.join(
            some, same & (F.col("print") != F.col("other")) & near).select("print", "other"))
    crowded = members.filter(F.col("size") > bucket).select("part", "key", "print")
    for probe in probes:  # who probes a crowded bucket joins it
        full = sizes.filter(F.col("n") > bucket)
        crowded = crowded.unionByName(lookup(durable(probe, "probes"), full, ["part", "key"], "n"))
    spread = durable(crowded.select("print").distinct(), "crowded")
    made = [pairs.select(F.col("print").alias("a"), F.col("other").alias("b"))]
    if not spread.isEmpty():
        values = spread.select("print", F.explode(F.transform(
            _flips(list(range(BITS)), distance // 2), lambda f: F.col("print").bitwiseXOR(f))).alias("value"))
        least = values.groupBy("value").agg(F.min("print").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        least = durable(least, "values")
        made.append(lookup(durable(values, "spread"), least, "value", "n").select("a", F.col("print").alias("b"))
                    .filter("a <> b").distinct())
    out = made[0]
    for part in made[1:]:
        out = out.unionByName(part)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, distance: int = 2, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """The other columns of ``docs``, ``fingerprint`` (hex), ``component_id`` and ``kept``.

    ``component_id`` is the smallest id reachable over fingerprints within ``distance``. One row of a
    component is kept: one of the smallest id.
    """
    made = ("fingerprint", "component_id", "kept")
    inner = [c for c in ("print", "row", "n", "root", "lead", "m", "first") if c not in (doc_id, text)]
    plain, back = aside(docs.select(*[c for c in docs.columns if c not in made or c in (doc_id, text)]), inner)
    rows = durable(with_fingerprints(plain, width, text).withColumn(
        "row", F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "row"))
    prints = durable(rows.groupBy("print").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    roots = components(links(prints.select("print"), distance))
    joined = durable(prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")), "joined")
    groups = durable(joined.groupBy("root").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("m")), "groups")
    named = durable(lookup(joined.select("print", "n", "root"), groups, "root", "m"), "named")
    found = lookup(rows, named, "print", "n")
    return back(found.select(
        *[c for c in rows.columns if c not in ("print", "row")],
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("lead.id").alias("component_id"), (F.col("row") == F.col("lead.row")).alias("kept")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, distance: int = 2, doc_id: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    docs, back = aside(docs, ["_row"])
    stored = with_row(docs)
    marks = near_duplicates(stored.select(doc_id, text, "_row"), width, distance, doc_id, text)
    gone = durable(marks.filter(~F.col("kept")).select("_row"), "gone")
    return back(stored.join(broadcast_if_small(gone), "_row", "left_anti").drop("_row"))
