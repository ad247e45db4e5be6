"""URL verdicts: rules first, then naive Bayes on segmented host words and path tokens.

Host labels are split into words by a unigram Viterbi search. The words and their counts come from the
text of all pages; only the counts of words that occur inside some host label are joined to it, so no
word list is collected. Rules give a verdict to the urls they fit, longest first; these urls also teach a
multinomial naive Bayes model, which judges the rest. Tokens are hashed into ``BUCKETS`` counts for each
verdict, so the model has one size whatever the tables.

A url that is null or has no ``://`` has an empty host and path, fits no rule, has no token and gets the
verdict of the prior (allow when even or nothing was learned). Null pages add no words. Repeated rows
are judged one by one; other columns pass through, except those with the names of the result. Labels and
urls of any length are read whole; words of more than ``LONGEST`` letters are not looked up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from streampace.llm.common import lookup
from streampace.plans.durable import durable

LONGEST = 20
BUCKETS = 1 << 16
ALLOW, BLOCK = "allow", "block"
MADE = ("host", "path", "rule", "verdict", "words", "block_score")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str       # with its leading slash

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """From ``host/path``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def _after_scheme(url: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty without a scheme."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def matched(rules: Sequence[Rule], host: Column, path: Column, what: str) -> Column:
    """Name or verdict of the longest rule that fits; of equally long ones the first by name."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


# ---- words of host labels -----------------------------------------------------------------------

def split_label(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely split into words. Unknown ones of n letters weigh 10 / (total * 10 ** n)."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            n = counts.get(word)
            weight = log(n / total) if n else log(10 / max(total, 1)) - len(word) * log(10)
            options.append((best[start][0] + weight, -(end - start), start))
        value, _, start = max(options)
        best.append((value, start))
    out, end = [], len(label)
    while end:
        out.append(label[best[end][1]:end])
        end = best[end][1]
    return out[::-1]


def word_counts(pages: DataFrame, html: str) -> DataFrame:
    """``(word, n)``: runs of a-z outside of tags, in lower case, over all pages."""
    text = F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode(F.split(text, "[^a-z]+")).alias("word"))
    return words.filter((F.col("word") != "") & (F.length("word") <= LONGEST)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


def segmented(labels: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """``(label, words)`` of distinct labels. Each label meets the counts of the words inside it."""
    span = F.sequence(F.lit(1), F.length("label"))
    inside = labels.filter("label <> ''").select("label", F.explode(span).alias("at")).select(
        "label", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label") - F.col("at") + 1))
                                 ).alias("size"))
    parts = inside.select("label", F.col("label").substr(F.col("at"), F.col("size")).alias("word")).distinct()
    known = parts.join(words, "word", "left").groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n")))).alias("counts"))

    @F.arrow_udf("array<string>")
    def split(label: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([split_label(a, dict(c), total) for a, c in
                         zip(label.to_pylist(), counts.to_pylist(), strict=True)], pa.list_(pa.string()))

    return known.select("label", split("label", "counts").alias("words"))


def host_words(hosts: DataFrame, pages: DataFrame, html: str) -> DataFrame:
    """``(host, n, words)`` of distinct ``hosts(host, n)``: the words of its labels in order."""
    words = durable(word_counts(pages, html), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labels = hosts.select("host", "n", F.posexplode(F.split("host", r"[^a-z]+")).alias("at", "label"))
    split = durable(segmented(labels.select("label").distinct(), words, total), "split")
    counts = labels.filter("label <> ''").groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    found = lookup(labels.filter("label <> ''"), durable(split.join(counts, "label"), "labels"), "label", "m")
    by_host = found.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(
        "at", "words"))), lambda x: x["words"])).alias("words"))
    return durable(hosts.join(by_host, "host", "left").withColumn(
        "words", F.coalesce("words", F.array().cast("array<string>"))), "hosts")


# ---- naive Bayes --------------------------------------------------------------------------------

def path_tokens(path: Column) -> Column:
    """Parts of the path in lower case; runs of digits stand for their length."""
    shaped = F.transform(F.split(F.lower(path), "[^\\p{L}\\p{N}]+"), lambda t: F.when(
        t.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t))
    return F.transform(F.filter(shaped, lambda t: t != ""), lambda t: F.concat(F.lit("p:"), t))


def bucket(token: str) -> int:
    return xxh64_intdigest(token.encode()) % BUCKETS


def learn(rows: DataFrame) -> np.ndarray:
    """Logarithms of block over allow: one for each bucket, then the prior. ``rows(tokens, verdict)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for tokens, verdict in zip(batch.column("tokens").to_pylist(), batch.column("verdict").to_pylist(),
                                       strict=True):
                side = int(verdict == BLOCK)
                total[side, BUCKETS] += 1
                np.add.at(total[side], [bucket(t) for t in tokens], 1)
        side, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(at), pa.array(total[side, at])],
                                         names=["side", "at", "n"])

    counts = np.zeros((2, BUCKETS + 1))
    # At most two counts for each bucket come to the driver.
    for side, at, n in rows.mapInArrow(run, "side long, at long, n long").groupBy("side", "at").agg(
            F.sum("n").alias("n")).collect():
        counts[side, at] = n
    tokens = counts[:, :BUCKETS] + 1.0
    prior = counts[:, BUCKETS] + 1.0
    ratio = np.log(tokens / tokens.sum(1, keepdims=True))
    return np.append(ratio[1] - ratio[0], log(prior[1] / prior[0]))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without url and html, with ``host, path, rule, verdict, words, block_score``."""
    host, path = host_and_path(url)
    kept = [c for c in pages.columns if c not in (url, html, *MADE)]
    rows = durable(pages.select(*kept, host.alias("host"), path.alias("path")), "urls")
    hosts = durable(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    words = host_words(hosts, pages, html)
    at_host, at_path = F.col("host"), F.col("path")
    tokens = F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), path_tokens(at_path))
    known = durable(lookup(rows, words, "host", "n").withColumns({
        "rule": matched(rules, at_host, at_path, "name"), "_ruled": matched(rules, at_host, at_path, "verdict"),
        "tokens": tokens}), "known")
    weights = learn(known.filter("_ruled is not null").select("tokens", F.col("_ruled").alias("verdict")))
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def blocked(values: pa.Array) -> pa.Array:
        w = shared.value
        total = np.array([w[BUCKETS] + sum(w[bucket(t)] for t in tokens) for tokens in values.to_pylist()])
        return pa.array(1 / (1 + np.exp(-np.clip(total, -50, 50))), pa.float64())

    scored = known.withColumn("block_score", blocked.asNondeterministic()("tokens"))
    verdict = F.coalesce("_ruled", F.when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW))
    return scored.select(*kept, "host", "path", "rule", verdict.alias("verdict"), "words", "block_score")
