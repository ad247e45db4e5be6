import hashlib
import io
from collections import Counter

import pytest

from streampace.llm import warc

BIG = "<p>" + "ü" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
ROWS = [(5, "http://a/", BIG), (3, "http://b/\r\nx", BIG), (9, None, BIG), (None, "http://c/", BIG), (3, "again", BIG),
        (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "z" * 100), (8, "u", "z" * 99),
        (10, "u", "z" * 99), (11, "u", "z" * 100), (12, "long", "lorem\n" * 100_000)]


def want(rows):
    out, first = [], {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (html or "").encode()
        again = len(body) >= 100 and body in first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                    first[body] if again else None))
        first.setdefault(body, page)
    return Counter(out)


def answer(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type",
                                               "refers_to").collect())


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, record string")


def test_round_trip_of_both_archives(spark, pages):
    captured = warc.capture(pages)
    raw = warc.read_archives(spark, captured).collect()
    assert Counter((r.page_id, r.payload) for r in raw) == Counter((p and str(p), h or "") for p, _, h in ROWS)
    assert {r.record_type for r in raw} == {"response"} and len({r.record_id for r in raw}) == len(ROWS)
    fresh = warc.deduplicate(spark, captured)
    assert answer(warc.resolved_pages(spark, fresh)) == want(ROWS)
    kept = warc.read_archives(spark, fresh).collect()
    by_record = {r.record_id: r for r in kept}
    for r in kept:
        if r.record_type == "revisit":
            assert r.payload == "" and by_record[r.refers_to_record].payload_digest == r.payload_digest
        else:
            assert hashlib.sha256(r.payload.encode()).hexdigest() == r.payload_digest
    # Archives that hold revisits already resolve to themselves.
    assert answer(warc.resolved_pages(spark, warc.deduplicate(spark, fresh))) == want(ROWS)


def test_one_payload_in_most_pages(spark):
    rows = [(i, "u", "same " * 30 if i % 5 else f"page {i} " * 20) for i in range(2, 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert answer(warc.resolved_pages(spark, warc.deduplicate(spark, warc.capture(pages)))) == want(rows)


def test_damage_is_found(spark, tmp_path):
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"nothing\r\n\r\n")))
    (tmp_path / "part-0").write_bytes(
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\n"
        b"WARC-Payload-Digest: sha256:00\r\nContent-Length: 1\r\n\r\na\r\n\r\n")
    with pytest.raises(Exception, match="another digest"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_empty_table(spark, pages):
    assert warc.resolved_pages(spark, warc.deduplicate(spark, warc.capture(pages.limit(0)))).count() == 0
