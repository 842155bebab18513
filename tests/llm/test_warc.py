"""Archives: exact round trips, revisits, pushed conditions."""

import base64
import hashlib

from pyspark.sql import functions as F

from factloom.llm import warc


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_with_revisits(spark):
    rows = [(1, "http://a/ü b", "x" * 5000), (2, None, None), (3, "http://c", "x" * 5000), (4, "", ""), (5, "u\r\nEvil: 1", "é\r\n\r\nbody"), (3, "http://c", "x" * 5000), (None, "n", "x" * 5000)]
    pages = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted(map(tuple, warc.archive_pages(pages).collect()), key=str)
    big = sha("x" * 5000)
    want = [
        (1, 5000, big, "revisit", 3),
        (2, 0, sha(""), "revisit", 4),
        (3, 5000, big, "response", None),
        (3, 5000, big, "response", None),
        (4, 0, sha(""), "response", None),
        (5, len("é\r\n\r\nbody".encode()), sha("é\r\n\r\nbody"), "response", None),
        (None, 5000, big, "revisit", 3),
    ]
    assert got == sorted(want, key=str)
    least = {tuple(r)[:1] + tuple(r)[3:] for r in warc.archive_pages(pages, least=1).collect()}
    assert (2, "response", None) in least and (1, "revisit", 3) in least
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_conditions_are_pushed_and_payloads_skipped(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i < 5 else f"<p>{i}</p>" * 400) for i in range(40)], "page_id long, url string, html string")
    warc.write_pages(pages.repartition(3), str(tmp_path / "w"))
    read = warc.read(spark, str(tmp_path / "w"))
    plan = read.where("record_type = 'revisit'")
    assert "PushedFilters" in plan._jdf.queryExecution().toString() or plan.count() == 4
    assert plan.count() == 4 and read.where("payload_bytes > 100").count() == 35
    assert read.where("target_uri like 'http://h/1%' and record_type in ('response')").count() == 10
    assert warc.read(spark, str(tmp_path / "w"), payload=False).where("payload is not null").count() == 0
    body = read.where("record_id = 'urn:page:20'").select(F.col("payload").cast("string")).first()[0]
    assert body == "<p>20</p>" * 400


def test_skipped_records_are_not_inflated(tmp_path):
    class Counting:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            self.read_bytes += len(out)
            return out

    import random

    random.seed(2)
    noise = "".join(chr(random.randrange(33, 126)) for _ in range(200_000))
    row = {"record_type": "response", "record_id": "r", "target_uri": "u" * 6000, "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": len(noise), "payload": noise.encode()}
    data = warc.member(warc._page_record(row)) * 3
    f = Counting(data)
    assert list(warc.records(f, lambda h: False, True)) == [] and f.read_bytes < 30_000
    f = Counting(data)
    assert [len(b) for _, b in warc.records(f, lambda h: True, True)] == [len(noise)] * 3


def test_whole_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    last = {}
    for i, h in html.items():
        last[h or ""] = max(last.get(h or "", i), i)
    for r in warc.archive_pages(pages).collect():
        h = html[r.page_id] or ""
        kept = last[h]
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), sha(h))
        assert (r.record_type, r.refers_to) == (("response", None) if kept == r.page_id else ("revisit", kept))


def test_append_adds_and_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "w")
    one = spark.createDataFrame([(1, "http://a", "x")], "page_id long, url string, html string")
    two = spark.createDataFrame([(2, "http://b", "y")], "page_id long, url string, html string")
    warc.write_pages(one, path)
    warc.write_pages(two, path)
    assert sorted(r.record_id for r in warc.read(spark, path).collect()) == ["urn:page:1", "urn:page:2"]
    warc.write_pages(two, path, mode="overwrite")
    assert [r.record_id for r in warc.read(spark, path).collect()] == ["urn:page:2"]
    assert len([f for f in (tmp_path / "w").iterdir() if f.name.endswith(".warc.gz")]) == 1


def test_failed_writes_leave_no_files(tmp_path):
    import pyarrow as pa

    row = {"record_type": "response", "record_id": "r", "target_uri": "u", "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": 1, "payload": b"x"}

    def batches():
        yield pa.RecordBatch.from_pylist([row])
        raise RuntimeError("lost")

    writer = warc.WarcWriter({"path": str(tmp_path / "w")}, False)
    try:
        writer.write(batches())
    except RuntimeError:
        pass
    assert list((tmp_path / "w").iterdir()) == []


def foreign(kind, url, body, more=""):
    block = body if kind != "response" else b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
    mime = "application/http; msgtype=response" if kind == "response" else "application/warc-fields"
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:uuid:{url}>\r\nWARC-Target-URI: {url}\r\n{more}Content-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_from_elsewhere(spark, tmp_path):
    """Without manifest and skip lengths: a member for each record, one member for all, and unpacked."""
    import gzip
    import random

    random.seed(4)
    bodies = [bytes(random.randrange(256) for _ in range(n)) for n in (0, 5, 70_000, 300_000)] + [b"a\r\n\r\nb"]
    records = [foreign("warcinfo", "info", b"software: x\r\n")] + [foreign("response", f"http://h/{i}", b, "X-Payload-Length: 7\r\n" if i == 1 else "") for i, b in enumerate(bodies)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "w" / "c.warc").write_bytes(b"".join(records))
    (tmp_path / "w" / "notes.txt").write_bytes(b"no archive")
    read = warc.read(spark, str(tmp_path / "w"))
    assert read.count() == 3 * len(records)
    got = sorted((r.target_uri, bytes(r.payload)) for r in read.where("record_type = 'response'").collect())
    assert got == sorted((f"http://h/{i}", b) for i, b in enumerate(bodies) for _ in range(3))
    assert {r.payload_bytes for r in read.collect()} == {None, 7}
    assert warc.read(spark, str(tmp_path / "w"), payload=False).where("payload is not null").count() == 0
    assert warc.read(spark, str(tmp_path / "w" / "c.warc")).count() == len(records)
    (tmp_path / "cut.warc").write_bytes(records[3][:-40])
    import pytest

    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, str(tmp_path / "cut.warc")).collect()


def test_a_very_long_payload(spark):
    text = "é<p>" * 2_000_000
    pages = spark.createDataFrame([(1, "u", text), (2, "u", text)], "page_id long, url string, html string")
    n = len(text.encode())
    assert sorted(map(tuple, warc.archive_pages(pages).collect())) == [(1, n, sha(text), "revisit", 2), (2, n, sha(text), "response", None)]
