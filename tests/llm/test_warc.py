import io

import pytest
from pyspark.sql import types as T

from tagloom.llm import warc
from tagloom.llm.base import stored

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def archive(tmp_path, n=40):
    a = warc.Archive(str(tmp_path))
    records = [warc.record("response", f"<urn:page:{i}>", f"http://x/{i}", f"<p>page number {i} of many</p>".encode() * (i + 1), None, "1970-01-01T00:00:00Z") for i in range(n)]
    for r in records:
        a.add(r)
    path, count, size = a.close()
    data = open(path, "rb").read()
    assert count == n and size == len(data)
    return records, data


def test_frames_with_and_without_dictionary(tmp_path):
    records, data = archive(tmp_path)
    assert data[:4] == warc.SKIPPABLE and list(warc.frames(io.BytesIO(data))) == records
    records, data = archive(tmp_path, 3)
    assert data[:4] == warc.FRAME and list(warc.frames(io.BytesIO(data))) == records
    assert list(warc.frames(io.BytesIO(b""))) == []


def test_damage_is_noticed(tmp_path):
    _, data = archive(tmp_path)
    for bad in (data[:-3], data[: len(data) // 2], data + b"junk", data[:4] + b"\xff\xff\xff\x00" + data[8:]):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(bad)))


def test_records_are_validated():
    good = warc.record("response", "<urn:page:1>", "http://x/ a\r\nb", "é".encode(), None, "1970-01-01T00:00:00Z")
    fields, payload, size = warc.parsed(good)
    assert fields["warc-target-uri"] == "http://x/%20a%0D%0Ab" and payload == "é".encode() and size == 2
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"\xc3", b"\xc4"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), b""):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    fields, payload, size = warc.parsed(warc.record("revisit", "<urn:page:1>", "u", b"abc", "<urn:page:2>", "1970-01-01T00:00:00Z"))
    assert payload == b"" and size == 3 and fields["warc-refers-to"] == "<urn:page:2>"


def test_round_trip(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (2, "again", "<p>a</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (None, "u", "<p>a</p>"), (None, "u", "alone")]
    out = {(r.name, r.kind, r.refers_to, r.payload_bytes, r.uri) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert out == {
        ("<urn:page:1>", "revisit", "<urn:page:2>", 8, "u"), ("<urn:page:2>", "response", None, 8, "urn:page:2"), ("<urn:page:2>", "response", None, 8, "again"),
        ("<urn:page:3>", "revisit", "<urn:page:4>", 0, "u"), ("<urn:page:4>", "response", None, 0, "u"), ("<urn:page:5>", "response", None, 600_000, "u"),
        ("<urn:page:>", "revisit", "<urn:page:2>", 8, "u"), ("<urn:page:>", "response", None, 5, "u"),
    }
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_payloads_come_back_and_archives_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(i, "u", f"text {i} " * 200) for i in range(60)]
    archives = stored(warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path)), "archives")
    assert archives.count() > 1 and archives.agg({"records": "sum"}).first()[0] == 60
    assert sorted(bytes(r.payload).decode() for r in warc.read_warc(archives).collect()) == sorted(h for _, _, h in rows)


def test_large_payloads_alone_are_shared(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    out = {r.name: r.kind for r in warc.round_trip(spark.createDataFrame(rows, PAGES), least=3).collect()}
    assert list(out.values()).count("revisit") == 1 and out["<urn:page:3>"] == "revisit"
