"""Exact round trips through the archive."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from pricetrail.llm.queries import QUERIES
from pricetrail.llm.warc import read_archive, write_archive

PAGES = [
    (1, "http://a/", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "http://c/\r\nX: y", "é" * 4000),
    (4, "http://d/", None), (7, "http://e/", ""), (6, "http://f/", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n"), (8, "http://ü/", "\x00\r\n\r\n"),
    (5, "http://b/", "<p>same</p>"), (None, "http://n/", "<p>same</p>"), (None, "http://m/", "alone"), (-9, "http://neg/", "minus"),
]


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        keys = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        head = max(keys, default=None)
        again = head is not None and page != head and len(payload) >= least
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if again else "response", head if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 12])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"sha256": F.lit("x"), "payload": F.lit(1), "head": F.lit(2)})
    write_archive(pages, str(tmp_path / "a"), least)
    got = read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(PAGES, least)
    assert all(r.sound for r in got)
    for r in got:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = rest[: int(fields["Content-Length"])]
        assert rest[len(body) :] == b"\r\n\r\n" and fields["WARC-Type"] == r.record_type
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload))
    payloads = spark.read.parquet(str(tmp_path / "a/payloads")).collect()
    assert sorted(bytes(p.payload) for p in payloads) == sorted({(h or "").encode() for _, _, h in PAGES})
    urls = {r.page_id: r.url for r in got}
    assert urls[2] == "http://c/%0D%0AX: y" and urls[3] is None and urls[8] == "http://ü/"


def test_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string")
    write_archive(pages, str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    assert {r.sound for r in read_archive(spark, str(tmp_path / "b")).collect()} == {False}


def test_no_pages(spark, tmp_path):
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert read_archive(spark, str(tmp_path / "a")).collect() == []


def test_the_query_verifies_and_rebuilds(spark):
    plan = QUERIES["op6_warc"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "Content-Length" in plan and "WARC-Payload-Digest" in plan and "sha1(" in plan


def test_every_record_is_dated(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    write_archive(pages, str(tmp_path / "a"), date="2024-05-01T00:00:00Z")
    for r in read_archive(spark, str(tmp_path / "a")).collect():
        assert r.sound and b"\r\nWARC-Date: 2024-05-01T00:00:00Z\r\n" in bytes(r.record)
