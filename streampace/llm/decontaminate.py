"""Benchmark passages in documents, by the q-gram lemma on diagonal bands.

A passage of m characters that occurs with at most e edits shares at least m + 1 - q (e + 1) q-grams with
its place, all of them on e + 1 neighbouring diagonals (text position minus passage position). Shared
q-grams are counted in overlapping bands of 2 e + 2 diagonals, so some band holds them all; bands that
reach the bound are verified by an alignment of the whole passage within the band.

Texts are compared in lower case with white space collapsed. The edit budget is a share of the passage,
lowered for short ones until the bound is at least one; passages shorter than q are matched exactly.
Null or empty passages occur nowhere, null texts hold nothing. Texts of any length are searched whole.
Of equal passages each is reported. Repeated rows are reported once each, empty tables give no match. Columns are
taken by name; documents without a match keep all their columns, whatever their names.

The passages are sent to all tasks in parts of at most ``PART`` characters, one pass over the documents
for each part, so a benchmark of any size can be searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streampace.llm.common import slices
from streampace.plans.durable import durable

Q = 10
BUDGET = 0.06
PART = 16_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def plain(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def budget(m: int, q: int, share: float) -> int:
    """Edits allowed in a passage of ``m`` bytes: at least one q-gram must survive them."""
    return max(0, min(int(m * share), (m - q) // q if m >= q else 0))


def gram_codes(data: np.ndarray, q: int) -> np.ndarray:
    """One 64-bit code for each run of ``q`` bytes; equal runs have equal codes."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code, length, powers = data.astype(np.uint64) + np.uint64(1), 1, _FACTOR
    out, done = None, 0
    while True:
        if q >> (length.bit_length() - 1) & 1:
            part = code[done:done + n]
            out = part.copy() if out is None else out * powers + part
            done += length
        if length * 2 > q:
            return out
        code = code[:-length] * powers + code[length:]
        length, powers = length * 2, np.uint64(int(powers) ** 2 & (1 << 64) - 1)


class Passages(NamedTuple):
    ids: np.ndarray
    texts: list[bytes]
    edits: np.ndarray
    need: np.ndarray        # q-grams that a place within the edits shares
    codes: np.ndarray       # sorted distinct codes
    first: np.ndarray       # per code the first of its places
    item: np.ndarray        # per place the passage, and the position in it
    place: np.ndarray
    seen: np.ndarray        # table of bits that most foreign codes miss
    short: list[int]


def prepare(items: list[tuple[int, bytes]], q: int, share: float) -> Passages:
    items = [(i, t) for i, t in items if t]
    texts = [t for _, t in items]
    edits = np.array([budget(len(t), q, share) for t in texts], np.int64)
    found = [gram_codes(np.frombuffer(t, np.uint8), q) for t in texts]
    sizes = [len(f) for f in found]
    item = np.repeat(np.arange(len(texts)), sizes)
    place = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, np.int64)])
    codes = np.concatenate(found or [np.zeros(0, np.uint64)])
    order = np.argsort(codes, kind="stable")
    distinct, first = np.unique(codes[order], return_index=True)
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[distinct >> np.uint64(64 - _FILTER_BITS)] = True
    need = np.array([len(t) for t in texts], np.int64) + 1 - q * (edits + 1)
    return Passages(np.array([i for i, _ in items], np.int64), texts, edits, need, distinct,
                    np.append(first, len(codes)), item[order], place[order], seen,
                    [k for k, t in enumerate(texts) if len(t) < q])


def align(passage: bytes, text: bytes, first: int, width: int, edits: int) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the best place of the whole passage on ``width`` diagonals from ``first``.

    Rows are letters of the passage, columns the diagonals of the band; a start on any of them is free.
    """
    m = len(passage)
    window = np.full(m + width, -1, np.int16)
    lo, hi = max(0, first), min(len(text), first + m + width)
    window[lo - first:hi - first] = np.frombuffer(text[lo:hi], np.uint8)
    column = np.arange(width)
    cost, start = np.zeros(width, np.int64), column.copy()
    for k, letter in enumerate(passage):
        new = cost + (window[k:k + width] != letter)
        came = start.copy()
        shorter = cost[1:] + 1 < new[:-1]       # a letter of the passage is missing in the text
        new[:-1][shorter], came[:-1][shorter] = cost[1:][shorter] + 1, start[1:][shorter]
        # Letters added in the text: the least of cost and distance over the diagonals to the left.
        level = new - column
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, column, 0))
        cost, start = least + column, came[source]
        if cost.min() > edits:
            return None
    at = int(cost.argmin())
    found = int(start[at]) + first, at + m + first
    return int(cost[at]), max(0, found[0]), min(len(text), found[1])


def occurrences(text: bytes, p: Passages, q: int) -> list[tuple[int, int, int, int]]:
    """``(passage, edits, start, end)`` for each passage that occurs; of several places the best first."""
    found = [(k, 0, at, at + len(p.texts[k])) for k in p.short if (at := text.find(p.texts[k])) >= 0]
    codes = gram_codes(np.frombuffer(text, np.uint8), q)
    hits = np.flatnonzero(p.seen[codes >> np.uint64(64 - _FILTER_BITS)])
    if not len(hits) or not len(p.codes):
        return found
    rank = np.minimum(np.searchsorted(p.codes, codes[hits]), len(p.codes) - 1)
    same = p.codes[rank] == codes[hits]
    hits, rank = hits[same], rank[same]
    counts = p.first[rank + 1] - p.first[rank]
    at = np.repeat(p.first[rank], counts) + (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    item, place = p.item[at], p.place[at]
    diagonal = np.repeat(hits, counts) - place
    # Fewer hits in the whole text than the bound: no band can reach it.
    enough = np.bincount(item, minlength=len(p.need)) >= p.need
    keep = enough[item]
    item, place, diagonal = item[keep], place[keep], diagonal[keep]
    if not len(item):
        return found
    # Each hit counts in the two bands that cover its diagonal; a place of the passage counts once a band.
    step = p.edits[item] + 1
    band = np.concatenate([diagonal // step, diagonal // step - 1])
    item2, place2 = np.tile(item, 2), np.tile(place, 2)
    cells = np.unique(np.stack([item2, band, place2], 1), axis=0)
    bands, hits_in = np.unique(cells[:, :2], axis=0, return_counts=True)
    best: dict[int, tuple[int, int, int]] = {}
    for k, b in bands[hits_in >= p.need[bands[:, 0]]].tolist():
        e = int(p.edits[k])
        hit = align(p.texts[k], text, b * (e + 1) - e, 4 * e + 2, e)
        if hit:
            best[k] = min(best.get(k, hit), hit)
    return found + [(k, *v) for k, v in best.items()]


@lru_cache(maxsize=2)
def _prepared(items: tuple[tuple[int, bytes], ...], q: int, share: float) -> Passages:
    return prepare(list(items), q, share)


def parts(benchmark: DataFrame, item_id: str, text: str, most: int = PART) -> Iterator[list[tuple[int, bytes]]]:
    """The passages in pieces of at most ``most`` characters, so that no piece outgrows a task."""
    sized = benchmark.filter(F.col(text).isNotNull()).select(
        F.col(item_id).cast("long").alias("item"), F.col(text).alias("passage"),
        F.length(text).alias("size"), F.monotonically_increasing_id().alias("place"))
    stored = durable(sized, "benchmark")
    total = stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    count = max(1, -(-total // most))
    group = F.pmod(F.xxhash64("item", "place"), F.lit(count))
    for part in range(count):
        yield sorted((r.item if r.item is not None else -1, plain(r.passage))
                     for r in stored.filter(group == part).toLocalIterator())


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = BUDGET,
            doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", most: int = PART) -> DataFrame:
    """``(doc_id, item_id, edits, start, end)``: which passages occur in which documents.

    ``start`` and ``end`` are byte positions in the compared form of the text. A null item id reads -1.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, edits long, start long, end long"
    out = None
    for items in parts(benchmark, item_id, item_text, most):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = _prepared(shared.value, q, share)
            for whole in batches:
                for batch in slices(whole, text):
                    rows, found = [], []
                    for i, t in enumerate(batch.column(text).to_pylist()):
                        for hit in occurrences(plain(t), p, q) if t else ():
                            rows.append(i)
                            found.append(hit)
                    table = np.array(found, np.int64).reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(doc_id).take(pa.array(rows, pa.int64())),
                         pa.array(p.ids[table[:, 0]] if len(table) else [], pa.int64()),
                         *[pa.array(table[:, c]) for c in (1, 2, 3)]],
                        names=["doc_id", "item_id", "edits", "start", "end"])

        part = docs.select(doc_id, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(shared: Broadcast, q: int, share: float) -> Callable[..., Column]:
    @F.arrow_udf("boolean")
    def clean(values: pa.Array) -> pa.Array:
        p = _prepared(shared.value, q, share)
        return pa.array([not (t and occurrences(plain(t), p, q)) for t in values.to_pylist()], pa.bool_())

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = BUDGET,
                      text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no passage occurs, with their columns."""
    for items in parts(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(items))
        docs = docs.filter(_clean(shared, q, share)(F.col(text)))
    return docs
