"""Spelling variants: the words of a corpus that differ by one edit, grouped below their most frequent form.

Words are counted over whole texts. A vocabulary acceptor composed with a one-edit transducer and with the
acceptor again accepts just the pairs of words that are one inserted, deleted or replaced code point apart. The acceptor
of all words is never built: of two such words, either the first half or the rest is equal, so the paths that leave the
state after a given half form a partition of their own, read from the left or from the right. A partition of more than
``GROUP`` words is cut at half of what is left, again and again; what shares all but one letter is no larger than the
alphabet squared. Each partition is minimised and composed in one task, and its accepted pairs are enumerated.
Every pair belongs to one partition: reading from the right leaves out the pairs that agree in the left half.

A word's form is its near word of largest count, if that is ``ratio`` times its own or more (ties: the smallest in
code-point order). Counts grow along forms, so a chain of forms ends; its last word is found by pointer doubling.

Null texts have no words; a null id counts as the empty text in the rule that damages words. Long texts are read in
pieces that end outside of words. Repeated rows count again. Words are counted before they are shuffled, so a frequent
word is a few rows. Other columns do not matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streampace.llm.common import slices
from streampace.plans.durable import durable

LEAST, OCCURRENCES, RATIO = 6, 5, 5   # code points and occurrences of a word; how much more frequent a form is
GROUP = 20_000                        # words of a partition that is not cut further
PIECE = 1 << 20                       # characters of a text that are read at once
DISTINCT = 300_000                    # words that a task counts before it sends them on
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OUTSIDE = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

Damage = Callable[[str, int], str]
#: Arcs of the one-edit transducer: (state, what it reads and writes, next state). Shorter to longer word only; a
#: deletion is an insertion seen from the other side. An insertion is placed after letters equal to it, so that each
#: pair is accepted once.
EQUAL, REPLACED, INSERTED = "a:a", "a:b", ":b"
ONE_EDIT = ((0, EQUAL, 0), (0, REPLACED, 1), (0, INSERTED, 2), (2, EQUAL, 1), (1, EQUAL, 1))
FINAL = (1, 2)


def drop_letter(word: str, checksum: int, every: int = 199) -> str:
    """The word without one letter where ``every`` divides the checksum."""
    if checksum % every:
        return word
    at = checksum % len(word)
    return word[:at] + word[at + 1:]


def lowered(word: str) -> str:
    """Lower case of A-Z only."""
    return word.lower() if word.isascii() else word.translate(_LOWER)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters that end where no word goes on."""
    start = 0
    while len(text) - start > size:
        edge = _OUTSIDE.search(text, start + size)
        if edge is None:
            break
        yield text[start:edge.start()]
        start = edge.start()
    yield text[start:]


def word_counts(docs: DataFrame, doc_id: str, text: str, damage: Damage | None, distinct: int = DISTINCT) -> DataFrame:
    """``word, n`` of the lower-cased runs, damaged by ``damage(word, crc32 of "<id>:<word>")``; not yet summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(found.values(), pa.int64())],
                                               names=["word", "n"])
            found.clear()
            return batch

        for whole in batches:
            for batch in slices(whole, "text"):
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for piece in pieces(value or ""):
                        for raw, n in Counter(RUN.findall(piece)).items():
                            word = lowered(raw)
                            found[damage(word, zlib.crc32(word.encode(), start)) if damage else word] += n
                        if len(found) > distinct:
                            yield out()
        yield out()

    return docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", damage: Damage | None = None,
               least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """Stored ``word, n`` of the words that are long and frequent enough."""
    return durable(word_counts(docs, doc_id, text, damage).groupBy("word").agg(F.sum("n").alias("n")).filter(
        (F.char_length("word") >= least) & (F.col("n") >= occurrences)), "words")


class Acceptor:
    """Minimised acyclic automaton of a sorted list of words; states with equal continuations are one."""

    def __init__(self, words: Sequence[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]   # of the word before: arcs, and whether it ends there
        letters = ""

        def close(keep: int) -> None:
            while len(path) - 1 > keep:
                arcs, ends = path.pop()
                name = (ends, *sorted(arcs.items()))
                if name not in known:
                    known[name] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(ends)
                path[-1][0][letters[len(path) - 1]] = known[name]

        for word in words:
            same = 0
            while same < min(len(word), len(letters)) and word[same] == letters[same]:
                same += 1
            close(same)
            path += [({}, False) for _ in word[same:]]
            path[len(word)] = (path[len(word)][0], True)
            letters = word
        close(0)
        self.start = len(self.arcs)
        self.arcs.append(path[0][0])
        self.final.append(path[0][1])


def one_edit_pairs(acceptor: Acceptor, length: int) -> Iterator[tuple[str, str]]:
    """Accepted pairs of acceptor o ``ONE_EDIT`` o acceptor whose first word has ``length`` letters.

    States of the composition are (acceptor, transducer, acceptor); only those that can be reached are made.
    Replacements are enumerated once, smaller letter first.
    """
    leaving: dict[int, list[tuple[str, int]]] = {}
    for state, label, after in ONE_EDIT:
        leaving.setdefault(state, []).append((label, after))
    arcs, final = acceptor.arcs, acceptor.final
    todo = [(acceptor.start, 0, acceptor.start, "", "")]
    while todo:
        p, e, q, x, y = todo.pop()
        if len(x) == length and e in FINAL and final[p] and final[q]:
            yield x, y
        for label, after in leaving[e]:
            if label == INSERTED:
                todo += [(p, after, to, x, y + b) for b, to in arcs[q].items()]
            elif len(x) == length:
                continue
            elif label == REPLACED:
                todo += [(of, after, to, x + a, y + b) for a, of in arcs[p].items() for b, to in arcs[q].items() if a < b]
            else:
                todo += [(arcs[p][a], after, arcs[q][a], x + a, y + a) for a in arcs[p].keys() & arcs[q].keys()
                         if e != 2 or a != y[-1]]


def _cut(parts: DataFrame) -> DataFrame:
    """Each partition once more from the left and once from the right, at half of what its words do not share."""
    left, right = F.col("left"), F.col("right")
    rest = F.col("size") - left - right
    half = F.floor(rest / 2).cast("int")
    return parts.withColumn("_to", F.explode(F.array(
        F.struct((left + half).alias("left"), right.alias("right"), F.col("edge")),
        F.struct(left.alias("left"), (right + rest - half).alias("right"), (left + half).alias("edge")),
    ))).select("word", "n", "size", "_to.left", "_to.right", "_to.edge")


def _partitions(words: DataFrame, least: int, group: int) -> DataFrame:
    """``word, n`` in every partition that it shares with another word, sorted by partition.

    ``size`` is the length of the shorter word of a pair; ``left`` and ``right`` letters are shared on each side, and
    the first ``edge`` letters of a pair differ somewhere (0: no matter).
    """
    key = ["size", "left", "right", "edge", "head", "tail"]
    length = F.char_length("word")
    zero = F.lit(0).cast("int")
    rest = words.withColumn("size", F.explode(F.array(length, length - 1))).filter(F.col("size") >= least).select(
        "word", "n", "size", zero.alias("left"), zero.alias("right"), zero.alias("edge"))
    done = []
    while True:
        members = Window.partitionBy(*key)
        sized = durable(_cut(rest).withColumns({
            "head": F.substring("word", F.lit(1), F.col("left")),
            "tail": F.substring("word", length - F.col("right") + 1, F.col("right")),
        }).withColumn("members", F.count(F.lit(1)).over(members)).filter("members > 1"), "partitions")
        crowded = (F.col("members") > group) & (F.col("size") - F.col("left") - F.col("right") > 1)
        done.append(sized.filter(~crowded))
        rest = durable(sized.filter(crowded).select("word", "n", "size", "left", "right", "edge"), "crowded")
        if rest.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(*key, "word", "n").repartition(*key).sortWithinPartitions(*key, "word")


def near_pairs(words: DataFrame, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """``word, n, near, near_n``: every pair of words that are one edit apart, in both directions."""

    def composed(size: int, left: int, right: int, edge: int, counts: dict[str, int]) -> Iterator[tuple]:
        cores = sorted((w[left:len(w) - right], w) for w in counts)
        named = dict(cores)
        for x, y in one_edit_pairs(Acceptor([c for c, _ in cores]), size - left - right):
            one, other = named[x], named[y]
            if not edge or one[:edge] != other[:edge]:
                yield one, counts[one], other, counts[other]
                yield other, counts[other], one, counts[one]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            word, n, near, near_n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())],
                names=["word", "n", "near", "near_n"])

        def groups() -> Iterator[tuple[tuple, dict[str, int]]]:
            at, counts = None, {}
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for *key, word, n in zip(*columns, strict=True):
                    if key != at:
                        if len(counts) > 1:
                            yield at, counts
                        at, counts = key, {}
                    counts[word] = n
            if len(counts) > 1:
                yield at, counts

        rows: list[tuple] = []
        for (size, left, right, edge, _, _), counts in groups():
            for pair in composed(size, left, right, edge, counts):
                rows.append(pair)
                if len(rows) == 10_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return _partitions(words, least, group).mapInArrow(run, "word string, n long, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` for stored ``links(word, root)`` by pointer doubling; chains of forms end."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(links.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = RATIO, least: int = LEAST, group: int = GROUP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of stored ``words(word, n)``."""
    lines = near_pairs(words, least, group).unionByName(words, allowMissingColumns=True)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("order"), "near", "near_n")))
    chosen = lines.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    wins = F.col("best.near_n") >= ratio * F.col("n")
    forms = durable(chosen.select("word", "n", "n_near", F.when(wins, F.col("best.near")).alias("form"),
                                  F.when(wins, F.col("best.near_n")).alias("form_n")), "forms")
    roots = _roots(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
