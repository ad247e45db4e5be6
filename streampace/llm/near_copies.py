"""Near copies by the similarity of their word runs: candidates of three kinds, each verified on the texts.

Two texts are near copies if the Jaccard similarity of their sets of word runs is ``similar`` or more; groups
are the components of that relation. Candidates are

* texts whose SimHash fingerprints lie within ``PRINT_DISTANCE`` bits, found by the generalised pigeonhole search of
  ``simhash.links``, which makes as many links as connect them;
* texts that agree in a band of ``BAND`` minimal hashes of their sets: 40 bands, so a pair at similarity 0.8
  shares none once in 2 * 10^5. Of a bucket of at most ``CELL`` texts all pairs are taken; in a larger one each text
  is paired with the hub, the text that shares most buckets with others;
* in larger buckets whose texts those links leave apart, the pairs that an exact prefix join finds: runs are ordered from
  rare to frequent among these texts, and two sets that are similar enough agree in one of the first runs of each, at
  places that leave room for as many common runs as they need. A text with many runs of its own has nothing but these in
  its prefix, so texts that stay apart do not meet, however crowded their buckets are.

A bit of each of 128 minimal hashes is kept as well, and candidates that differ in more than ``DISTANCE`` of them are
left out; of pairs at 0.8 that is one in 10^5, and fewer of closer ones. Every other candidate is decided on the sets
themselves, so no link is below ``similar``.

Texts with equal sets are one text from the start. Null and wordless texts have the empty set and are
copies of one another. Null ids count as the largest. Of repeated rows one stays. Texts of any length are read whole.
Columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from streampace.llm import simhash
from streampace.llm.common import aside, lookup, with_row
from streampace.llm.components import components
from streampace.llm.exact_dedup import normalised
from streampace.llm.simhash import SEED, fingerprints, shingle_hashes
from streampace.plans.durable import broadcast_if_small, durable

HASHES, BAND = 240, 6
BITS = 128
DISTANCE = 28           # mean 12.8 and deviation 3.4 at similarity 0.8
PRINT_DISTANCE = 4      # bits of 64 in which fingerprints of candidates may differ
CELL = 32               # texts of a bucket that are all compared
BLOCK = 256             # texts of a crowded prefix bucket that meet in one task
PAIR_BYTES = 16 << 20   # sets that meet in one verifying task
_draw = np.random.default_rng(SEED)
_ADD = _draw.integers(0, 1 << 64, HASHES, np.uint64)
_TIMES = _draw.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per nonempty set the names of its bands, and 128 bits as two numbers."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    h = np.concatenate(sets)
    least = np.stack([np.minimum.reduceat((h ^ a) * m, starts) for a, m in zip(_ADD, _TIMES, strict=True)], 1)
    bits = np.packbits((least[:, :BITS] >> np.uint64(20) & np.uint64(1)).astype(bool), axis=1).view(np.int64)
    bands = least.reshape(len(sets), -1, BAND)
    names = np.broadcast_to(_ADD[:HASHES // BAND], bands.shape[:2])
    for k in range(BAND):
        names = (names ^ bands[:, :, k]) * _TIMES[k]
        names = names ^ names >> np.uint64(29)
    return names.view(np.int64), bits


def _described(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """Stored ``id, _row`` with the set's digest and size, its bands and bits, and the text's fingerprint."""
    schema = docs.select(F.col(doc_id).alias("id"), "_row").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in normalised(batches):
            hashes = [shingle_hashes(t, width) for t in texts]
            sets = [np.unique(h) for h in hashes]
            some = [i for i, s in enumerate(sets) if len(s)]
            bands, bits = [None] * len(sets), np.zeros((len(sets), 2), np.int64)
            if some:
                found, bits[some] = signatures([sets[i] for i in some])
                for i, names in zip(some, found, strict=True):
                    bands[i] = names
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(fingerprints(hashes))],
                names=["id", "_row", "digest", "size", "bands", "bits0", "bits1", "print"])

    for name, kind in (("digest", "binary"), ("size", "long"), ("bands", ArrayType(LongType())), ("bits0", "long"), ("bits1", "long"), ("print", "long")):
        schema = schema.add(name, kind)
    return durable(docs.select(F.col(doc_id).alias("id"), "_row", text).mapInArrow(run, schema), "described")


def _sets(docs: DataFrame, width: int, text: str) -> DataFrame:
    """Stored ``node, shingles``: the sorted hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in normalised(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [np.unique(shingle_hashes(t, width)).tobytes() for t in texts], pa.binary())], names=["node", "shingles"])

    return durable(docs.select("node", text).mapInArrow(run, "node long, shingles binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Stored ``(a, b)``: the pairs of stored ``pairs(a, b, bytes)`` whose sets are similar enough.

    Pairs are dealt by both ends over a square of tasks, and a set is sent to each task once.
    """
    total = pairs.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    side = max(8, ceil(sqrt(total / PAIR_BYTES)))
    placed = pairs.select("a", "b", (F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side))
                                     ).alias("task"))
    ends = placed.select("task", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node").select(
        F.col("task").alias("at"), "node", "shingles")

    def run(some: pa.Table, known: pa.Table) -> pa.Table:
        shingles = {n: np.frombuffer(s, np.uint64) for n, s in zip(
            known.column("node").to_pylist(), known.column("shingles").to_pylist(), strict=True)}
        kept = []
        for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True):
            one, other = shingles[a], shingles[b]
            both = len(np.intersect1d(one, other, assume_unique=True))
            kept.append(both >= similar * (len(one) + len(other) - both) - 1e-9)
        return some.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return durable(placed.groupBy("task").cogroup(ends.groupBy("at")).applyInArrow(run, "a long, b long"), "verified")


def _fits(similar: float) -> Column:
    """Whether sizes and bits of the texts ``node`` and ``_node`` of a joined row allow the similarity."""
    differ = F.bit_count(F.col("bits0").bitwiseXOR(F.col("_bits0"))) + F.bit_count(F.col("bits1").bitwiseXOR(F.col("_bits1")))
    return (F.least("size", "_size") >= F.greatest("size", "_size") * similar - 1e-9) & (differ <= DISTANCE)


def _other(rows: DataFrame, *more: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"_{c}" for c in ("node", "size", "bits0", "bits1", *more)})


def _candidates(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"),
                         ((F.col("size") + F.col("_size")) * 8).alias("bytes"))


def _by_prints(nodes: DataFrame, similar: float) -> DataFrame:
    """Candidates whose fingerprints are near: texts of one fingerprint with its first one, first ones with each other."""
    prints = durable(nodes.groupBy("print").agg(
        F.min(F.struct("node", "size", "bits0", "bits1")).alias("lead"), F.count(F.lit(1)).alias("n")), "prints")
    twins = lookup(nodes.select("print", "node", "size", "bits0", "bits1"), prints.filter("n > 1"), "print", "n").select(
        "node", "size", "bits0", "bits1", *[F.col(f"lead.{c}").alias(f"_{c}") for c in ("node", "size", "bits0", "bits1")])
    near = durable(simhash.links(prints.select("print"), PRINT_DISTANCE), "near")
    ends = prints.select("print", "lead.*")
    met = near.join(ends.withColumnRenamed("print", "a"), "a").join(_other(ends).withColumnRenamed("print", "b"), "b")
    return _candidates(twins.unionByName(met.drop("a", "b")).filter((F.col("node") != F.col("_node")) & _fits(similar)))


def _by_prefixes(sets: DataFrame, about: DataFrame, similar: float) -> DataFrame:
    """Candidates among the texts of stored ``about(node, size, bits0, bits1, root)`` that have different roots: all
    that an exact prefix join finds. ``sets`` holds the runs of these texts and maybe others."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.frombuffer(runs, np.int64)
                for i in range(0, len(tokens), 100_000):
                    part = tokens[i:i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(part)], names=["node", "run"])

    runs = durable(sets.join(about.select("node"), "node", "left_semi").select("node", "shingles").mapInArrow(
        split, "node long, run long"), "runs")
    # Runs of one text only name no pair, but take their places at the head of its prefix.
    often = durable(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    known = lookup(runs, often.withColumn("often", F.col("n")), "run", "n")
    placed = known.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "run"))).alias("runs")).join(about, "node")
    alone = F.col("size") - F.size("runs")
    length = (F.col("size") - F.ceil(F.col("size") * similar - 1e-9) + 1).cast("int")
    prefix = placed.select("node", "size", "bits0", "bits1", "root", F.posexplode(F.slice(
        "runs", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int"))).alias("at", "r"), alone.alias("alone")).select(
        "node", "size", "bits0", "bits1", "root", "r.run", (F.col("alone") + F.col("at")).alias("at"))
    prefix = durable(prefix, "prefixes")

    # In each bucket the texts that are not of its largest root meet all others, which are dealt in blocks.
    roots = durable(prefix.groupBy("run", "root").agg(F.count(F.lit(1)).alias("m")), "roots")
    buckets = durable(roots.groupBy("run").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.sum("m").alias("n"),
                                               F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"), "buckets")
    met = durable(lookup(prefix, buckets.withColumn("members", F.col("n")), "run", "n"), "met")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    here = met.withColumn("block", F.pmod(F.xxhash64("node", "run"), blocks).cast("int"))
    rest = met.filter(F.col("root") != F.col("main")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    room = F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at"))
    need = F.ceil((F.col("size") + F.col("_size")) * (similar / (1 + similar)) - 1e-9)
    there = _other(here.select("run", "block", "node", "size", "bits0", "bits1", "root", "at"), "root", "at")
    joined = rest.alias("l").join(there.alias("r"), (F.col("l.run") == F.col("r.run")) & (F.col("l.block") == F.col("r.block"))
                                  & (F.col("root") != F.col("_root")) & (room >= need) & _fits(similar))
    return _candidates(joined)


def links(nodes: DataFrame, docs: DataFrame, width: int, similar: float, text: str = "text") -> DataFrame:
    """Verified links that connect the same stored ``nodes`` as all candidates would; ``docs`` has their texts by ``_row``."""
    about = nodes.select("node", "size", "bits0", "bits1")
    named = nodes.select("node", F.explode("bands").alias("band"))
    shared = durable(named.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn(
        "members", F.col("n")), "bands")
    found = durable(lookup(named, shared, "band", "n"), "found")
    central = found.groupBy("node").agg(F.sum("members").alias("central"))
    members = durable(found.join(about.join(central, "node"), "node"), "members")
    small = members.filter(F.col("members") <= CELL).select("band", "node", "size", "bits0", "bits1")
    crowded = members.filter(F.col("members") > CELL)
    hubs = durable(crowded.groupBy("band").agg(F.max(F.struct("central", "node", "size", "bits0", "bits1")).alias("hub"),
                                               F.count(F.lit(1)).alias("n")), "hubs")
    spokes = lookup(crowded.select("band", "node", "size", "bits0", "bits1"), hubs, "band", "n").select(
        "node", "size", "bits0", "bits1", *[F.col(f"hub.{c}").alias(f"_{c}") for c in ("node", "size", "bits0", "bits1")])
    met = small.join(_other(small), "band").filter(F.col("node") < F.col("_node")).drop("band").unionByName(
        spokes.filter(F.col("node") != F.col("_node"))).filter(_fits(similar))
    pairs = durable(_candidates(met).unionByName(_by_prints(nodes.filter("size > 0"), similar)).distinct(), "pairs")

    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(
        crowded.select("node")).distinct().join(nodes.select("node", F.col("lead._row").alias("_row")), "node"), "wanted")
    sets = _sets(docs.join(broadcast_if_small(wanted), "_row"), width, text)
    first = verified(pairs, sets, similar)
    if hubs.isEmpty():
        return first

    roots = components(first)
    rooted = durable(crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = durable(rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")
                                               ).filter("lo <> hi").select("band", "n"), "mixed")
    apart = durable(lookup(rooted, mixed, "band", "n").select("node", "size", "bits0", "bits1", "root").distinct(), "apart")
    if apart.isEmpty():
        return first
    return first.unionByName(verified(durable(_by_prefixes(sets, apart, similar).distinct(), "pairs"), sets, similar))


def drop_near_copies(docs: DataFrame, width: int = 5, similar: float = 0.8, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """One row of each group, one of the smallest id, with the columns of ``docs``."""
    docs, back = aside(docs, ["_row"])
    stored = with_row(docs)
    rows = _described(stored.select(doc_id, text, "_row"), width, doc_id, text)
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_row"))
    nodes = durable(rows.groupBy("digest").agg(
        lead.alias("lead"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("size", "bands", "bits0", "bits1", "print")]
    ).withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = components(links(nodes, stored.select("_row", text), width, similar, text))
    joined = durable(nodes.select("node", "digest", "lead", "n").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")), "joined")
    groups = durable(joined.groupBy("root").agg(F.min("lead").alias("lead"), F.count(F.lit(1)).alias("m")), "groups")
    named = durable(lookup(joined.select("digest", "n", "root"), groups, "root", "m"), "named")
    gone = durable(lookup(rows.select("digest", "_row"), named, "digest", "n").filter(
        F.col("_row") != F.col("lead._row")).select("_row"), "gone")
    return back(stored.join(broadcast_if_small(gone), "_row", "left_anti").drop("_row"))
