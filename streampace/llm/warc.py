"""WARC archives in which equal payloads are stored once.

Records are written with Spark's text writer, one row per record, with the record terminator of the format
as line separator and compressed; so files are committed like any other output and survive lost
executors. A file holds at most ``FILE_RECORDS`` records of a task. A file is read as one compressed value, which
must be smaller than 2 GB, and unpacked as a stream that is parsed by the lengths in the headers, so payloads may hold
anything; the digest of every payload is verified.

Revisit resolution reads only headers: they are shuffled by payload digest, the first page of each
payload is its response, and the others become revisit records that name it. Fresh archives then hold
every payload once.

A null payload is empty, a null url an empty target. Payloads under ``LEAST`` bytes are always responses.
Of repeated rows of the first page one is the response; null ids come last. The payload of a revisit is
found through its digest. Payloads of any length are stored whole. Columns are taken by name; others do not matter
and are not archived. An empty table gives archives without records and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streampace.llm.common import lookup
from streampace.plans.durable import broadcast_if_small, durable, new_path

LEAST = 100
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_RECORDS = 20_000
GZIP = b"\x1f\x8b"
RESPONSE, REVISIT = "response", "revisit"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# Names of the extension fields that carry ids, and of the standard fields that are read back.
PAGE, REFERS = "WARC-Page-ID", "WARC-Refers-To-Page-ID"
HEADER = ("file string, at long, length long, record_id string, record_type string, page_id string, "
          "url string, payload_digest string, refers_to_record string, refers_to string")


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null. Line breaks in a value become spaces."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(
        value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("")


def record(row: dict[str, Column]) -> Column:
    """A record without its terminator. ``row``: record_id, record_type, page_id, url, payload,
    payload_digest, refers_to_record, refers_to, date."""
    revisit = row["record_type"] == REVISIT
    body = F.when(revisit, F.lit("")).otherwise(row["payload"])
    return F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", row["record_type"]),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), row["record_id"], F.lit(">"))),
        _field("WARC-Date", row["date"]), _field("WARC-Target-URI", row["url"]), _field(PAGE, row["page_id"]),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), row["payload_digest"])),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), row["refers_to_record"], F.lit(">")))),
        _field(REFERS, F.when(revisit, row["refers_to"])),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.octet_length(body)), F.lit("\r\n"), body)


def write_archives(records: DataFrame, spark: SparkSession) -> str:
    """Write the column ``record`` where its rows are, without a shuffle; returns the fresh folder."""
    path = new_path(spark, "warc")
    records.select("record").write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


# ---- reading ------------------------------------------------------------------------------------

def parse(file: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, header fields, body)`` of each record of a file."""
    at = 0
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields, size = {}, len(line)
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
            size += len(line)
        length = int(fields["Content-Length"])
        body = file.read(length)
        if len(body) < length or file.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, fields, body
        at += size + 2 + length + 4


def _urn(value: str | None) -> str | None:
    return value and value.removeprefix("<urn:uuid:").removesuffix(">")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all files: the header columns and, if asked for, ``payload`` as text.

    A payload whose digest differs from its header is an error.
    """
    schema = HEADER + (", payload string" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                stream = pa.BufferReader(content.as_buffer())
                zipped = content.as_buffer()[:2].to_pybytes() == GZIP
                for at, f, body in parse(gzip.open(stream) if zipped else io.BufferedReader(stream)):
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == RESPONSE and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"the payload at byte {at} of {file} has another digest")
                    rows.append((file, at, len(body), _urn(f["WARC-Record-ID"]), kind, f.get(PAGE),
                                 f.get("WARC-Target-URI"), digest, _urn(f.get("WARC-Refers-To")), f.get(REFERS),
                                 *([body.decode()] if payload else [])))
                    size += len(body)
                    if size > 1 << 22:
                        yield _batch(rows, names)
                        rows, size = [], 0
                yield _batch(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


_KINDS = {"at": pa.int64(), "length": pa.int64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), _KINDS.get(n, pa.string())) for c, n in zip(columns, names, strict=True)], names=names)


# ---- the two archives ---------------------------------------------------------------------------

def record_id(*values: Column) -> Column:
    """A name-based id of 32 hexadecimal digits in the usual groups."""
    h = F.md5(F.concat_ws("\x00", F.lit(str(_SPACE)), *values))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def capture(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            date: str = "1970-01-01T00:00:00Z") -> str:
    """Archives with one response record per page; returns their folder."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn(
        "place", F.monotonically_increasing_id())
    row = {"record_type": F.lit(RESPONSE), "page_id": F.col("page_id"), "url": F.col("url"), "payload": F.col("payload"),
           "payload_digest": F.sha2(F.col("payload").cast("binary"), 256),
           "refers_to_record": F.lit(None), "refers_to": F.lit(None), "date": F.lit(date)}
    named = rows.withColumn("record_id", record_id(F.col("page_id").cast("string"), F.col("place").cast("string")))
    row["record_id"] = F.col("record_id")
    return write_archives(named.select(record(row).alias("record")), pages.sparkSession)


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """Stored ``(record_id, to_page, to_record)`` of the records that are to be revisits.

    ``headers`` is stored. The response of the smallest page of each digest stays one; other responses
    become revisits of it, and revisits found in the input name it too. An input revisit whose response
    is not there is not listed and keeps the reference it has.
    """
    page = F.expr("try_cast(page_id AS bigint)")
    revisit = F.col("record_type") == REVISIT
    order = F.struct(revisit.alias("revisit"), page.isNull().alias("none"), page.alias("page"), "page_id", "record_id")
    firsts = durable(headers.filter(revisit | (F.col("length") >= least)).groupBy("payload_digest").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and not first.revisit"), "firsts")
    return durable(lookup(headers.select("record_id", "payload_digest"), firsts, "payload_digest", "n").filter(
        F.col("record_id") != F.col("first.record_id")).select(
        "record_id", F.col("first.page_id").alias("to_page"), F.col("first.record_id").alias("to_record")), "revisits")


def deduplicate(spark: SparkSession, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> str:
    """Fresh archives with every payload of ``path`` once; returns their folder.

    Payloads stay in the task that reads them if the list of revisits is small enough to be sent to all;
    otherwise they are shuffled once by record.
    """
    headers = durable(read_archives(spark, path, False), "headers")
    revisits = broadcast_if_small(resolve(headers, least))
    again = F.col("to_record").isNotNull()
    joined = read_archives(spark, path).join(revisits, "record_id", "left").withColumns({
        "record_type": F.when(again, REVISIT).otherwise(F.col("record_type")),
        "refers_to": F.when(again, F.col("to_page")).otherwise(F.col("refers_to")),
        "refers_to_record": F.coalesce("to_record", "refers_to_record")})
    row = {c: F.col(c) for c in ("record_type", "page_id", "url", "payload", "payload_digest", "refers_to_record",
                                 "refers_to", "record_id")} | {"date": F.lit(date)}
    return write_archives(joined.select(record(row).alias("record")), spark)


def resolved_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of deduplicated archives, read back: ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to``. The size of a revisit's payload is that of its response."""
    found = durable(read_archives(spark, path, False), "read")
    responses = found.filter(F.col("record_type") == RESPONSE)
    revisits = found.filter(F.col("record_type") == REVISIT).withColumn("target", F.col("refers_to_record"))
    counts = revisits.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    targets = durable(counts.join(responses.select(F.col("record_id").alias("target"), F.col("length").alias("size")),
                                  "target", "left"), "targets")
    columns = [F.col("page_id").cast("long").alias("page_id"), "url", F.col("size").alias("payload_bytes"),
               "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")]
    resolved = lookup(revisits, targets, "target", "n")
    return responses.withColumn("size", F.col("length")).select(*columns).unionByName(resolved.select(*columns))
