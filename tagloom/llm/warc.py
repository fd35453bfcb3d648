"""WARC archives of one Zstandard frame per record, with the dictionary in a leading skippable frame.

A task writes its rows to archives of bounded size in the shared folder and returns one row for each. Names
hold a fresh id and only returned archives are read, so a repeated or lost attempt leaves no wrong record.
Archives are read as streams: memory is bounded by the largest record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.base import bounded, id_key, stored
from tagloom.session import scratch_path

#: Fixed values of the formats.
VERSION = b"WARC/1.1"
SKIPPABLE, DICTIONARY, FRAME = b"\x5d\x2a\x4d\x18", b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")

ARCHIVE_BYTES = 64_000_000
DICTIONARY_BYTES = 16_384
SAMPLES = 200
LEVEL = 3
READ = 16_384
#: Duplicates up to this many rows are looked up by broadcast, more by shuffle.
BROADCAST_REVISITS = 200_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, uri: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit that only has its HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", uri))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """Trained on the first records of an archive; empty if they are too few or too alike for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class Archive:
    """Writes records to one archive; the first ones wait until the dictionary is trained on them."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = pyarrow.fs.FileSystem.from_uri(self.path)
        self.out = fs.open_output_stream(path, compression=None)
        self.waiting: list[bytes] | None = []
        self.held = self.size = self.records = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            return self._frame(data)
        self.waiting.append(data)
        self.held += len(data)
        if len(self.waiting) >= SAMPLES or self.held >= ARCHIVE_BYTES // 8:
            self._begin()

    def _begin(self) -> None:
        words = dictionary(self.waiting)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        if words:
            content = zstandard.ZstdCompressor(level=19).compress(words)
            self._write(SKIPPABLE + struct.pack("<I", len(content)) + content)
        waiting, self.waiting = self.waiting, None
        for data in waiting:
            self._frame(data)

    def _frame(self, data: bytes) -> None:
        self._write(self.packer.compress(data))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        if self.waiting is not None:
            self._begin()
        self.out.close()
        return self.path, self.records, self.size


def frames(stream) -> Iterator[bytes]:
    """The records of an archive: its frames, decoded with the dictionary of the leading skippable frame.

    Raises ValueError for a frame that is cut short or no frame at all.
    """
    data, words = stream.read(8), None
    if data[:4] == SKIPPABLE:
        size = struct.unpack("<I", data[4:])[0]
        content = stream.read(size)
        if len(content) != size:
            raise ValueError("the dictionary is cut short")
        if content[:4] == FRAME:
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        if content[:4] != DICTIONARY:
            raise ValueError("the leading frame is no dictionary")
        words, data = zstandard.ZstdCompressionDict(content), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=words)
    while data := data or stream.read(READ):
        frame, parts = unpacker.decompressobj(), []
        while data:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ValueError(f"not a frame: {e}") from None
            if frame.eof:
                break
            data = stream.read(READ)
        if not frame.eof:
            raise ValueError("the last frame is cut short")
        yield b"".join(parts)
        data = frame.unused_data


def parsed(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(header fields in lower case, payload, full length of the payload) of one record; ValueError if it is not valid."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0].encode() != VERSION:
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header field: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    if missing := [x for x in REQUIRED if x not in fields]:
        raise ValueError(f"without {missing}")
    if fields["warc-type"] not in TYPES:
        raise ValueError(f"unknown type {fields['warc-type']}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']}: Content-Length does not match the block")
    block = rest[:-4]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, block, len(block)
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\ncontent-length: *(\d+)", http, re.IGNORECASE)
    size = int(length[1]) if length else len(payload)
    if not gap or fields["warc-type"] == "response" and size != len(payload):
        raise ValueError(f"{fields['warc-record-id']}: the HTTP length does not match the payload")
    if fields["warc-type"] == "response" and fields.get("warc-payload-digest", "sha1:" + digest(payload)) != "sha1:" + digest(payload):
        raise ValueError(f"{fields['warc-record-id']}: the payload does not match its digest")
    return fields, payload, size


def revisits(pages: DataFrame, id_col: str, html_col: str, least: int) -> DataFrame:
    """(k, sha, top): rows whose payload also occurs under a larger id, top."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.filter(F.octet_length(payload) >= least).select(id_key(id_col).alias("k"), F.sha1(payload).alias("sha"), F.col(id_col).cast("long").alias("id"))
    groups = rows.groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null")
    return rows.join(groups, "sha").filter("k <> top").select("k", "sha", "top").distinct()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns (path, records, bytes) per archive.

    Of rows with equal payload of at least ``least`` bytes that with the largest id is a response; the others are
    revisits that refer to it. Rows of that same id are all responses, and so are rows of a group without any id.
    A null html is an empty payload, a null address becomes ``urn:page:<id>``.
    """
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    known = bounded(revisits(pages, id_col, html_col, least), BROADCAST_REVISITS, "revisits")
    rows = (
        pages.select(id_key(id_col).alias("k"), F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
        .withColumn("sha", F.sha1("html")).join(known, ["k", "sha"], "left")
        .select(name("id").alias("name"), F.coalesce("uri", F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("uri"), "html", F.when(F.col("top").isNotNull(), name("top")).alias("top"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for b in batches:
            for n, uri, html, top in zip(b.column("name").to_pylist(), b.column("uri").to_pylist(), b.column("html").cast(pa.binary()).to_pylist(), b.column("top").to_pylist(), strict=True):
                if archive is None or archive.size >= ARCHIVE_BYTES:
                    done += [archive.close()] if archive else []
                    archive = Archive(folder)
                archive.add(record("revisit" if top else "response", n, uri, html, top, date))
        done += [archive.close()] if archive else []
        for path, records, size in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return rows.mapInArrow(write, "path string, records long, bytes long")


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``path``: name, kind, uri, refers_to, payload_digest (bare), payload_bytes and payload.

    Every record is validated; the first that is not right fails the job and names the archive. ``payloads``
    false leaves payloads null once they are checked. Records come as often as their archive is named.
    """
    names = ["name", "kind", "uri", "refers_to", "payload_digest", "payload_bytes", "payload"]

    def rows(path: str) -> Iterator[tuple]:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_stream(inner, compression=None) as stream:
            try:
                for data in frames(stream):
                    fields, payload, size = parsed(data)
                    yield fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, size, payload if payloads and fields["warc-type"] != "revisit" else None
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column("path").to_pylist():
                part, held = [], 0
                for row in rows(path):
                    part.append(row)
                    held += 200 + len(row[6] or b"")
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names)

    return archives.select("path").mapInArrow(read, "name string, kind string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads these back."""
    folder = scratch_path(pages.sparkSession, "warc")
    _make(pages.sparkSession, folder)
    archives = stored(write_warc(pages, folder, least=least), "archives")
    n = archives.count()
    return read_warc(archives.repartition(max(1, min(n, 4 * pages.sparkSession.sparkContext.defaultParallelism)), "path"), payloads=False)


def _make(spark: SparkSession, folder: str) -> None:
    """Makes the folder by Spark's own file system, as executors may only write into folders that exist."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
