"""The archive: exact round trip, one payload for all copies, damage."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import warc
from tallyframe.session import new_path

ROWS = [(1, "http://a/1", "<p>é</p>", 0), (2, "http://a/2", "<p>é</p>", 0), (3, None, None, 0),
        (4, "u\r\nWARC-Type: x", "", 0), (None, "n", "<p>é</p>", 0), (5, "r", "same", 0),
        (5, "r", "same", 0), (6, "l", "x" * 300_000, 0), (None, "only", "null id", 0)]


@pytest.fixture(scope="module")
def archive(spark):
    path = new_path(spark, "archive")
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, size int")
    warc.write_archive(pages.withColumn("key", F.lit(1)), path)
    return path


def test_round_trip(spark, archive):
    got = warc.read_archive(spark, archive).collect()
    assert len(got) == len(ROWS)
    sent = sorted(((r[0] or 0), (r[2] or "").encode()) for r in ROWS)
    assert sorted(((r.page_id or 0), bytes(r.payload)) for r in got) == sent
    for r in got:
        digest = base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        assert r.payload_digest == digest and r.payload_bytes == len(r.payload)
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields["WARC-Type"] == r.record_type
        assert body == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n"
        assert int(fields["Content-Length"]) == len(body) - 4


def test_response_and_revisits(spark, archive):
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to or 0, r.url)
                  for r in warc.read_archive(spark, archive).collect()), key=str)
    kinds = sorted((i, k, to) for i, k, to, _ in got)
    assert kinds == sorted([(1, "revisit", 2), (2, "response", 0), (0, "revisit", 2),
                            (3, "revisit", 4), (4, "response", 0), (5, "response", 0),
                            (5, "revisit", 5), (6, "response", 0), (0, "response", 0)])
    assert ("u%0D%0AWARC-Type: x") in {u for *_, u in got}


def test_payloads_once(spark, archive):
    assert spark.read.parquet(f"{archive}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_small_payloads_do_not_revisit(spark):
    path = new_path(spark, "archive")
    pages = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string, size int")
    warc.write_archive(pages, path, min_bytes=100)
    assert {r.record_type for r in warc.read_archive(spark, path).collect()} == {"response"}


def test_damage_stops_the_job(spark, archive):
    path = new_path(spark, "damaged")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{path}/headers")
    spark.read.parquet(f"{archive}/payloads").withColumn(
        "payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, path).collect()


def test_empty(spark):
    path = new_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).collect() == []
