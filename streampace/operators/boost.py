"""Boosted regression trees under the absolute loss, fitted by histograms.

The first tree is fitted to the labels; each further one, with the weight ``STEP``, to the signs of what is left, as in
Spark's boosting with the loss ``absolute``. Features are replaced once by the numbers of their bins, a byte each. For each level
of a tree the tasks count rows and add targets by node, feature and bin, Spark adds the counts, and the driver gets nodes x
features x bins of them, whatever the number of rows. A task holds one batch; nothing is cached in memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streampace.functions import windows as fw
from streampace.operators.huber import packed
from streampace.plans.durable import durable
from streampace.plans.packed import pack, unpack
from streampace.session import ship

BINS = 32
SAMPLE = 10_000   # rows that the bounds of the bins are taken from, as in Spark's trees; all rows are fitted
STEP = 0.1
ROWS = 16_384     # rows that are counted at once


class Tree(NamedTuple):
    """A whole binary tree: for each inner node, level by level, its feature and the greatest value that goes left; a
    value for each leaf. Where a node is not split, both sides have the same leaves."""

    feature: list[int]
    bound: list[float]
    leaf: list[float]


def leaf_of(columns: Sequence[np.ndarray] | np.ndarray, feature: Sequence[int], bound: Sequence[float]) -> np.ndarray:
    """The number of the node that each row reaches below the last level given; ``columns`` holds a feature each."""
    at = np.zeros(len(columns[0]), np.uint8 if len(bound) < 255 else np.int32)
    first = 0
    while first < len(bound):
        n = first + 1      # nodes of this level
        right = np.zeros(len(at), at.dtype)
        for j in range(n):
            beyond = ~(columns[feature[first + j]] <= bound[first + j])
            right |= (beyond & (at == j)).astype(at.dtype) if n > 1 else beyond.astype(at.dtype)
        at = at * 2 + right
        first += n
    return at


def value_of(columns: Sequence[np.ndarray] | np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    total = np.zeros(len(columns[0]))
    for i, t in enumerate(trees):
        total += np.array(t.leaf)[leaf_of(columns, t.feature, t.bound)] * (STEP if i else 1.0)
    return total


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Column ``prediction`` of the vector ``features``."""

    feature = Param(Params._dummy(), "feature", "of each inner node of each tree", TypeConverters.toListInt)
    bound = Param(Params._dummy(), "bound", "greatest value that goes left", TypeConverters.toListFloat)
    leaf = Param(Params._dummy(), "leaf", "values of the leaves of each tree", TypeConverters.toListFloat)
    count = Param(Params._dummy(), "count", "number of trees", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)

    def __init__(self, trees: Sequence[Tree] = (), width: int = 0) -> None:
        super().__init__()
        self._set(width=width, feature=[x for t in trees for x in t.feature], bound=[x for t in trees for x in t.bound],
                  leaf=[x for t in trees for x in t.leaf], count=len(trees))

    def trees(self) -> list[Tree]:
        lists = [self.getOrDefault(p) for p in (self.feature, self.bound, self.leaf)]
        n = self.getOrDefault(self.count)
        return [Tree(*[x[i * len(x) // n:(i + 1) * len(x) // n] for x in lists]) for i in range(n)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees()
        return dataset.withColumn("prediction", fw.mapped(
            vector_to_array("features"), self.getOrDefault(self.width),
            lambda rows: value_of(np.ascontiguousarray(rows.T), trees)))


def bounds_of(stored: DataFrame, width: int, seed: int) -> list[np.ndarray]:
    """For each feature at most ``BINS - 1`` bounds between its values, from ``SAMPLE`` random rows of packed ``stored``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        kept, keys, count = np.empty((0, width + 1)), np.empty(0), 0
        for batch in batches:
            if batch.num_rows:
                rows = unpack(batch.column(0), width * 8 + 8).view(np.float64)
                key, count = draw.random(len(rows)), count + len(rows)
                few = np.flatnonzero(key < np.partition(keys, SAMPLE - 1)[SAMPLE - 1]) if len(keys) >= SAMPLE else slice(None)
                kept, keys = np.concatenate([kept, rows[few]]), np.concatenate([keys, key[few]])
                if len(keys) > SAMPLE:
                    least = np.argpartition(keys, SAMPLE)[:SAMPLE]
                    kept, keys = kept[least], keys[least]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(
                [r.tobytes() for r in kept], pa.binary())], names=["key", "packed"])

    rows = stored.mapInArrow(run, "key double, packed binary").orderBy("key").limit(SAMPLE).select("packed").collect()
    if not rows:
        raise ValueError("no rows to fit")
    sample = np.array([np.frombuffer(r[0], np.float64)[:-1] for r in rows])
    out = []
    for values in sample.T:
        known = np.unique(values)
        if len(known) <= BINS:
            out.append((known[:-1] + known[1:]) / 2)
        else:
            bounds = np.unique(np.quantile(values, np.arange(1, BINS) / BINS, method="lower"))
            out.append(bounds[bounds < known[-1]])
    return out


def binned(stored: DataFrame, bounds: Sequence[np.ndarray]) -> DataFrame:
    """Packed rows of a byte for the bin of each feature, and the label's eight, of packed rows of doubles."""
    width = len(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = unpack(batch.column(0), width * 8 + 8).view(np.float64)
                out = np.empty((len(data), width + 8), np.uint8)
                for i, b in enumerate(bounds):
                    out[:, i] = np.searchsorted(b, data[:, i])
                out[:, width:] = np.ascontiguousarray(data[:, -1]).view(np.uint8).reshape(-1, 8)
                yield pack(out)

    return stored.mapInArrow(run, "packed binary")


def histograms(stored: DataFrame, width: int, trees: Sequence[Tree], feature: Sequence[int], bound: Sequence[int]) -> DataFrame:
    """``cell, n, total``: rows and targets of the tree after ``trees`` by (node, feature, bin) of its next level. The trees'
    bounds, and ``bound`` of the levels there are, are numbers of bins."""
    nodes = len(bound) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((width, nodes * BINS)), np.zeros((width, nodes * BINS))
        for batch in batches:
            rows = unpack(batch.column(0), width + 8) if batch.num_rows else ()
            for start in range(0, len(rows), ROWS):
                data = rows[start:start + ROWS]
                columns = np.ascontiguousarray(data[:, :width].T)
                label = np.ascontiguousarray(data[:, width:]).view(np.float64)[:, 0]
                node = leaf_of(columns, feature, bound).astype(np.intp)
                if trees:       # targets are signs, which are counted as two sides of a node
                    base = (node * 2 + ~(label - value_of(columns, trees) < 0)) * BINS
                    for i in range(width):
                        sides = np.bincount(base + columns[i], minlength=nodes * 2 * BINS).reshape(nodes, 2, BINS)
                        n[i] += sides.sum(1).ravel()
                        total[i] += (sides[:, 1] - sides[:, 0]).ravel()
                    continue
                for i in range(width):
                    at = node * BINS + columns[i]
                    n[i] += np.bincount(at, minlength=nodes * BINS)
                    total[i] += np.bincount(at, label, nodes * BINS)
        n, total = (x.reshape(width, nodes, BINS).swapaxes(0, 1).ravel() for x in (n, total))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some])], names=["cell", "n", "total"])

    return stored.mapInArrow(run, "cell long, n double, total double").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))


def _grown(stored: DataFrame, width: int, trees: Sequence[Tree], depth: int) -> Tree:
    """The next tree; bounds are numbers of bins."""
    feature, bound = [], []
    value = np.zeros(1)
    for _ in range(depth):
        nodes = len(bound) + 1
        n, total = np.zeros(nodes * width * BINS), np.zeros(nodes * width * BINS)
        for r in histograms(stored, width, trees, feature, bound).collect():
            n[r.cell], total[r.cell] = r.n, r.total
        n, total = n.reshape(nodes, width, BINS), total.reshape(nodes, width, BINS)
        below = []
        for node in range(nodes):
            left, left_sum = n[node].cumsum(1)[:, :-1], total[node].cumsum(1)[:, :-1]
            rows, whole = n[node, 0].sum(), total[node, 0].sum()
            both = (left > 0) & (left < rows)
            gain = np.full(left.shape, -np.inf)
            gain[both] = left_sum[both] ** 2 / left[both] + (whole - left_sum[both]) ** 2 / (rows - left[both]) - whole ** 2 / rows
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[f, b] > 0:
                feature.append(int(f))
                bound.append(int(b))
                below += [left_sum[f, b] / left[f, b], (whole - left_sum[f, b]) / (rows - left[f, b])]
            else:      # all rows go left; both sides have the node's value
                feature.append(0)
                bound.append(BINS)
                mean = whole / rows if rows else value[node]
                below += [mean, mean]
        value = np.array(below)
    return Tree(feature, bound, value.tolist())


def fit(rows: DataFrame, width: int, max_iter: int = 10, max_depth: int = 4, seed: int = 42) -> list[Tree]:
    """Trees over ``rows(features array, label)`` with ``width`` features. Rows without a label are left out."""
    ship(rows.sparkSession)
    doubles = durable(packed(rows.filter(F.col("label").isNotNull())), "samples")
    bounds = bounds_of(doubles, width, seed)
    stored = durable(binned(doubles, bounds), "bins")
    grown: list[Tree] = []
    for _ in range(max_iter):
        grown.append(_grown(stored, width, grown, max_depth))
    most = [np.append(b, [np.finfo(float).max] * (BINS + 1 - len(b))) for b in bounds]
    return [Tree(t.feature, [float(most[f][b]) for f, b in zip(t.feature, t.bound, strict=True)], t.leaf) for t in grown]
