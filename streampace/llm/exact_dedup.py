"""Exact duplicates by naming blocks.

A normalised text (A-Z lower-cased) is cut into blocks of fixed size. The distinct blocks are sorted and
get integer names; adjacent names are then paired, the distinct pairs sorted and named, until each text
has one name. Equal names mean equal texts: every naming step compares whole keys, never digests.

Blocks travel to their name under a 128-bit hash, so texts are shuffled once, as distinct blocks. That
no two different blocks share a hash is checked; if any do, the hash is seeded anew.

Null counts as the empty text, which is one empty block. Null ids are allowed and lose against any other;
of repeated rows with the same id and text one stays. Long texts take one more round for each doubling.
Other columns do not matter and do not come back. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streampace.llm.common import lookup, slices
from streampace.plans.durable import durable

BLOCK = 4096
Digest = Callable[[bytes, int], bytes]


def blocks_of(text: bytes, size: int) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text) or 1, size)]


def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches whose last column is the text, with the texts in lower case as UTF-8."""
    for whole in batches:
        for batch in slices(whole, whole.schema.names[-1]):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            yield batch, [(t or b"").lower() for t in texts]


def _rows(docs: DataFrame, doc_id: str, text: str, size: int, digest: Digest, seed: int) -> DataFrame:
    """One row per document: ``doc_id, text_sha256, hashes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in normalised(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                 pa.array([[digest(b, seed) for b in blocks_of(t, size)] for t in texts],
                          pa.list_(pa.binary()))], names=["doc_id", "text_sha256", "hashes"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(
        run, f"doc_id {kind}, text_sha256 string, hashes array<binary>")


def _names(docs: DataFrame, text: str, size: int, digest: Digest, seed: int) -> DataFrame:
    """Distinct blocks in sorted order: ``hash, name, n`` with the number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in normalised(batches):
            found = Counter(b for t in texts for b in blocks_of(t, size))
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(b, seed) for b in found], pa.binary()), pa.array(found, pa.binary()),
                 pa.array(found.values(), pa.int64())], names=["hash", "block", "n"])

    found = docs.select(text).mapInArrow(run, "hash binary, block binary, n long")
    return _named(found.groupBy("hash", "block").agg(F.sum("n").alias("n")), "block").drop("block")


def _named(keys: DataFrame, *order: str) -> DataFrame:
    """Integer names in sorted order within each partition, unique over all of them."""
    return keys.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK,
               digest: Digest = xxhash.xxh3_128_digest) -> DataFrame:
    """Stored table ``(row, doc_id, text_sha256, level, name)``; equal ``(level, name)``: equal texts."""
    for seed in range(100):
        names = durable(_names(docs, text, size, digest, seed), "names")
        if names.groupBy("hash").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("the digest gives different blocks the same hash for every seed")
    rows = durable(_rows(docs, doc_id, text, size, digest, seed).withColumn(
        "row", F.monotonically_increasing_id()), "rows")
    short = rows.filter(F.size("hashes") == 1).select(
        "row", "doc_id", "text_sha256", F.col("hashes")[0].alias("hash"))
    done = [lookup(short, names, "hash", "n").select(
        "row", "doc_id", "text_sha256", F.lit(0).alias("level"), "name")]
    long = rows.filter(F.size("hashes") > 1)
    pieces = long.select("row", F.size("hashes").alias("left"), F.posexplode("hashes").alias("pos", "hash"))
    state = durable(lookup(pieces, names, "hash", "n").select("row", "left", "pos", "name"), "level")
    level = 0
    ends = []
    while not state.isEmpty():
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = durable(state.groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.floor((F.first("left") + 1) / 2).cast("int").alias("left"),
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
        named = durable(_named(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "a", "b"), "names")
        whole = durable(lookup(pairs, named, ["a", "b"], "n").select("row", "left", "pos", "name"), "level")
        ends.append(whole.filter("left = 1").select("row", F.lit(level).alias("level"), "name"))
        state = whole.filter("left > 1")
    for end in ends:
        done.append(long.select("row", "doc_id", "text_sha256").join(end, "row"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return durable(out, "identities")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK,
                 digest: Digest = xxhash.xxh3_128_digest) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the largest id of each group of equal texts stays.
    """
    rows = identities(docs, doc_id, text, size, digest)
    groups = durable(rows.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    ).withColumn("n", F.col("group_size")), "groups")
    return lookup(rows, groups, ["level", "name"], "n").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")
