"""Secrets in every historical version of a set of files, found once per content and rule.

A version ``(path, version, content)`` is named by the SHA-256 of its content: its blob. A ledger on storage
holds which pairs of blob and rule version were scanned, and the spans found in each blob. :func:`scan` names
the blobs of the versions it is given, scans only the pairs that the ledger lacks, reading each new blob
from one of its rows, and appends to the ledger; :func:`findings` joins the spans back to all versions. So copies, moved
files and reverted changes cost a digest, and a new version of a rule costs one pass over the blobs for that rule.

Only DataFrame functions run. A rule's matches are taken out in order, the text is split at the same matches,
and the running sum of the lengths of both gives each match's place in code points, summed over rows of one
blob and rule, however many there are.

The spans of a scan are written before the pairs they belong to, under the scan's name, and only spans of a scan
whose pairs are there count. A scan that was lost half-way is repeated without a trace.

Null content is the empty text. Null paths and versions are allowed, and repeated rows come back as often as they
were given. A blob of a third of all versions is scanned once, and its result is dealt to as many copies as it has
thousandths of the rows. Long texts are scanned whole. Columns are taken by name; others do not matter. An empty table
gives an empty result and leaves the ledger as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streampace.llm.common import HOT_KEYS
from streampace.plans.durable import durable

_SPANS = "scan string, blob string, kind string, rule_version int, start long, end long"
_PAIRS = "scan string, blob string, kind string, rule_version int"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more are spans of ``kind``."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0


# The base rules. Letters of the names count in either case (ASCII only). Runs of the last two are as
# long as they can be, so a least length in the pattern finds the same spans without listing every short run.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
# Formats that issuers publish.
ISSUED = (
    Rule("private_key", 1, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ISSUED


def blob_of(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def _named(versions: DataFrame, content: str) -> DataFrame:
    """``content, row``; rows of files are named by file and position, those of other tables are stored first."""
    text = F.col(content).alias("content")
    if versions._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return versions.select(text, F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
    return durable(versions.select(text, F.monotonically_increasing_id().alias("row")), "contents")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        fields = [f.split() for f in schema.split(", ")]
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])


def scanned(spark: SparkSession, ledger: str) -> DataFrame:
    """``scan, blob, kind, rule_version``: the pairs that were scanned."""
    return _stored(spark, f"{ledger}/pairs", _PAIRS)


def spans(spark: SparkSession, ledger: str, rules: Sequence[Rule]) -> DataFrame:
    """``blob, kind, rule_version, start, end`` of the given rule versions, from scans that were completed.

    If two scans of the same pair ran at the same time, the one with the smaller name counts.
    """
    pairs = scanned(spark, ledger).filter(_among(rules)).groupBy("blob", "kind", "rule_version").agg(F.min("scan").alias("scan"))
    return _stored(spark, f"{ledger}/spans", _SPANS).filter(_among(rules)).join(
        pairs, ["scan", "blob", "kind", "rule_version"], "left_semi").drop("scan")


def _among(rules: Sequence[Rule]) -> Column:
    return F.struct("kind", "rule_version").isin(
        [F.struct(F.lit(r.kind), F.lit(r.version)) for r in rules])


def _pieces(text: Column, rule: Rule) -> Column:
    """Per match the characters before it since the last one, its own, and those that count."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    lengths = F.transform(F.arrays_zip(
        whole.alias("hit"), counted.alias("part"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)).alias("gap")),
        lambda m: F.struct(F.char_length(m["gap"]).alias("gap"), F.char_length(m["hit"]).alias("size"),
                           F.char_length(m["part"]).alias("counted")))
    return F.when(F.size(whole) > 0, lengths)


def _found(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob, kind, rule_version, start, end`` in rows ``blob, kinds, content``; ``kinds`` are still to be scanned."""
    each = F.array(*[F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), F.lit(r.least).alias("least"),
        F.when(F.array_contains("kinds", r.kind), _pieces(F.col("content"), r)).alias("pieces")) for r in rules])
    matches = blobs.select("blob", F.explode(F.filter(each, lambda r: r["pieces"].isNotNull())).alias("r")).select(
        "blob", "r.kind", "r.rule_version", "r.least", F.posexplode("r.pieces").alias("at", "m"))
    before = Window.partitionBy("blob", "kind").orderBy("at")
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(
        before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return matches.withColumn("end", end).filter(F.col("m.counted") >= F.col("least")).select(
        "blob", "kind", "rule_version", (F.col("end") - F.col("m.size")).alias("start"), "end")


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, content: str = "content") -> int:
    """Scan the pairs of blob and rule version that ``ledger`` lacks; returns how many there were."""
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("one version of each kind of rule is scanned at a time")
    spark, name = versions.sparkSession, uuid.uuid4().hex
    rows = _named(versions, content)
    blobs = durable(rows.select(blob_of(F.col("content")).alias("blob"), "row").groupBy("blob").agg(
        F.min("row").alias("row")), "blobs")
    every = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules]))
    known = scanned(spark, ledger).select("blob", "kind", "rule_version")
    unseen = durable(blobs.withColumn("rule", every).select("blob", "row", "rule.kind", "rule.rule_version").join(
        known, ["blob", "kind", "rule_version"], "left_anti"), "unseen")
    some = unseen.count()
    if not some:
        return 0
    wanted = unseen.groupBy("blob", "row").agg(F.collect_list("kind").alias("kinds"))
    found = _found(rows.join(wanted, "row").select("blob", "kinds", "content"), rules)
    found.select(F.lit(name).alias("scan"), "*").write.mode("append").parquet(f"{ledger}/spans")
    unseen.select(F.lit(name).alias("scan"), "blob", "kind", "rule_version").write.mode("append").parquet(f"{ledger}/pairs")
    return some


def findings(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ("path", "version"),
             content: str = "content") -> DataFrame:
    """``*keys, blob, spans`` for every version; ``spans`` holds ``start, order, kind, end`` in order.

    ``order`` is the place of the rule among ``rules``. A version whose blob was not scanned has no spans.
    """
    spark = versions.sparkSession
    named = durable(versions.select(F.struct(*keys).alias("key"), blob_of(F.col(content)).alias("blob")), "versions")
    order = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind")).cast("int")
    found = spans(spark, ledger, rules).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end"))).alias("spans"))
    # Blobs of more than a thousandth of all versions, fewer than a thousand, are dealt to several copies.
    total = named.count()
    hot = F.broadcast(named.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > max(total // HOT_KEYS, 1)).select("blob", F.ceil(F.col("n") * HOT_KEYS / max(total, 1)).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    left = named.join(hot, "blob", "left").withColumn("copy", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), copies).cast("int"))
    right = found.join(hot, "blob", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return left.drop("copies").join(right.drop("copies"), ["blob", "copy"], "left").select(
        "key.*", "blob", F.coalesce("spans", F.array().cast(right.schema["spans"].dataType)).alias("spans"))


def of_kind(found: str, kind: str) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
