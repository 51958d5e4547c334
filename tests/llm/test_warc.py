import hashlib

import pytest

from textforge.llm import warc
from textforge.llm.scratch import fresh_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
LIE = "WARC/1.1\r\nContent-Length: 999999\r\n\r\n"


def pages(spark):
    body = "<p>é漢 page</p>" * 20
    rows = [(1, "u", body), (5, "u", body), (3, "u\r\nX: y", body), (2, None, None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"),
            (8, "u", "x" + FAKE + "tail" * 50), (9, "u", FAKE * 30), (10, "u", LIE + "z" * 300), (11, "u", "WARC/1.1\r\n"),
            (12, "u", "end\r\n\r\n" + LIE), (None, "u", "no id " * 40), (13, "u", FAKE * 30), (14, "u", "\r\n\r\n" * 40)]
    rows += [(100 + i, "u", f"filler {i} " * (i % 40)) for i in range(200)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        f = first.get(h)
        again = f is not None and f != i
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", ["128m", "3000"])
def test_round_trip_with_magic_in_payloads(spark, block):
    """Also with file blocks so small that a chain crosses many of them."""
    rows, df = pages(spark)
    path = warc.write_archives(df.repartition(3), fresh_path(spark, "warc-test"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        out = warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        got = sorted((tuple(r) for r in out.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == brute(rows)


def test_archives_are_plain_warc(spark):
    rows, df = pages(spark)
    path = warc.write_archives(df.coalesce(1), fresh_path(spark, "warc-test"))
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    at = n = 0
    while at < len(raw):                                   # a sequential reader
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
        at += len(head) + 4 + length + 4
        n += 1
    assert at == len(raw) and n == len(rows)


def test_empty(spark):
    _, df = pages(spark)
    path = warc.write_archives(df.limit(0), fresh_path(spark, "warc-test"))
    assert warc.read_archives(spark, path).count() == 0
