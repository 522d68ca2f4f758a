"""WARC archives as a PySpark Python data source.

Reading: files are the partitions (small ones share one); record-type and header predicates are pushed
down; headers are parsed first, and the payload of an unwanted record is not decoded. Archives written
here name the length of each gzip member in its header (the "sl" field), so that an unwanted record is
passed over without inflating it. Writing: each task writes whole files under passing names; a list of
the committed files keeps those of lost attempts out.
"""
from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import ready, shared_path
from .files import Output, listed, opened, put

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")
#: WARC header behind each column that predicates reach.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
#: Fixed value: the profile of a revisit record.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
FILE_BYTES = 128 << 20
COMMITTED = "_committed.txt"
LEAST_SHARED = 100


def _line(name: str, value) -> bytes:
    clean = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{name}: {clean}\r\n".encode("utf-8", "surrogatepass")


def record(kind: str, record_id: str, target: str | None, refers_to: str | None, digest: str | None, size: int | None, payload: bytes | None) -> bytes:
    """One WARC record; a response carries an HTTP header and the payload, a revisit the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", size or 0) + b"\r\n"
    body = {"response": http + (payload or b""), "revisit": http}.get(kind, payload or b"")
    head = b"WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", record_id) + _line("WARC-Date", DATE)
    if target is not None:
        head += _line("WARC-Target-URI", target)
    if kind == "revisit":
        head += _line("WARC-Profile", SAME_PAYLOAD)
    if refers_to is not None:
        head += _line("WARC-Refers-To", refers_to)
    if digest is not None:
        head += _line("WARC-Payload-Digest", f"sha256:{digest}")
    if kind in ("response", "revisit"):
        head += _line("Content-Type", "application/http; msgtype=response")
    return head + _line("Content-Length", len(body)) + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member of one record, with its compressed and plain length in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    whole = 24 + len(packed) + 8
    head = struct.pack("<4sIBBH2sHII", b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, whole & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Found:
    headers: dict[str, str]
    block: bytes | None


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _member_length(head: bytes) -> int | None:
    """The length that the extra field of a gzip header names, if any."""
    if len(head) >= 12 and head[3] & 4:
        end = 12 + struct.unpack("<H", head[10:12])[0]
        at = 12
        while at + 4 <= min(end, len(head)):
            n = struct.unpack("<H", head[at + 2 : at + 4])[0]
            if head[at : at + 2] == b"sl" and n >= 4:
                return struct.unpack("<I", head[at + 4 : at + 8])[0] or None
            at += 4 + n
    return None


def records(stream, wanted, payload: bool) -> Iterator[Found]:
    """Records whose headers are ``wanted``; blocks only of those, and only if ``payload``."""
    stream.seek(0)
    if stream.read(2) == b"\x1f\x8b":
        yield from _packed_records(stream, wanted, payload)
    else:
        yield from _plain_records(stream, wanted, payload)


def _plain_records(stream, wanted, payload: bool) -> Iterator[Found]:
    at = 0
    while True:
        stream.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            more = stream.read(4096)
            if not more:
                return
            head += more
        n = head.index(b"\r\n\r\n")
        headers = _headers(head[:n])
        size = int(headers.get("content-length", 0))
        if wanted(headers):
            block = None
            if payload:
                stream.seek(at + n + 4)
                block = stream.read(size)
            yield Found(headers, block)
        at += n + 4 + size + 4


def _packed_records(stream, wanted, payload: bool) -> Iterator[Found]:
    at = 0
    while True:
        stream.seek(at)
        chunk = stream.read(4096)
        if not chunk:
            return
        length = _member_length(chunk)
        unpack, plain = zlib.decompressobj(31), b""
        read = len(chunk)
        plain = unpack.decompress(chunk, 4096)
        while b"\r\n\r\n" not in plain and not unpack.eof:
            if unpack.unconsumed_tail:
                plain += unpack.decompress(unpack.unconsumed_tail, 4096)
            elif chunk := stream.read(65536):
                read += len(chunk)
                plain += unpack.decompress(chunk, 4096)
            else:
                raise ValueError("a record ends within its headers")
        n = plain.index(b"\r\n\r\n")
        headers = _headers(plain[:n])
        take = wanted(headers)
        if not (take and payload) and length:
            at += length  # passed over without inflating it
            if take:
                yield Found(headers, None)
            continue
        parts = [plain]
        while not unpack.eof:
            chunk = unpack.unconsumed_tail or stream.read(65536)
            if not chunk:
                raise ValueError("a record is cut off")
            read += 0 if unpack.unconsumed_tail else len(chunk)
            part = unpack.decompress(chunk, 1 << 20)
            if take and payload:
                parts.append(part)
        at += read - len(unpack.unused_data)
        if take:
            size = int(headers.get("content-length", 0))
            yield Found(headers, b"".join(parts)[n + 4 : n + 4 + size] if payload else None)


def _http(block: bytes | None) -> tuple[dict[str, str], bytes]:
    head, _, body = (block or b"").partition(b"\r\n\r\n")
    return _headers(head), body


@dataclass
class Files(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    """Plans files, keeps the predicates it can decide from headers, reads headers first."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.share = int(options.get("partitionbytes", FILE_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((name, "given", None))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            got = _column(headers, name)
            if got is None or how == "in" and got not in value or how == "starts" and not got.startswith(value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        found = listed(self.path)
        names = {f for f, _ in found}
        manifest = f"{self.path.rstrip('/')}/{COMMITTED}"
        if manifest in names:
            with opened(manifest) as f:
                committed = set(f.read().decode().split())
            found = [x for x in found if x[0].rsplit("/", 1)[-1] in committed]
        else:
            found = [x for x in found if re.search(r"\.warc(\.gz)?$", x[0])]
        out, room = [], 0
        for file, size in found:
            if room < size:
                out.append(Files([]))
                room = self.share
            out[-1].files.append(file)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files):
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for file in partition.files:
            with opened(file) as stream:
                for r in records(stream, self.wanted, self.payload):
                    http, body = _http(r.block)
                    kind = _column(r.headers, "record_type")
                    size = len(body) if kind == "response" and r.block is not None else None
                    if kind == "revisit" and r.block is not None:
                        size = int(http["content-length"]) if "content-length" in http else None
                    payload = body if kind == "response" and r.block is not None else None
                    rows.append([*[_column(r.headers, c) for c in names[:5]], size, payload])
                    held += len(r.block or b"") + 200
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


def _column(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(HEADERS[name])
    return value.removeprefix("sha256:") if name == "payload_digest" and value is not None else value


@dataclass
class Wrote(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.most = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator) -> Wrote:
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = Output(f"{self.path}/{files[-1]}"), 0
                    info = record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", None, None, None, None, b"format: WARC File Format 1.1\r\n")
                    out.stream.write(member(info))
                data = member(record(row["record_type"], row["record_id"], row["target_uri"], row["refers_to"], row["payload_digest"], row["payload_bytes"], row["payload"]))
                out.stream.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Wrote(files)

    def commit(self, messages) -> None:
        put(f"{self.path}/{COMMITTED}", "\n".join(f for m in messages if m is not None for f in m.files).encode())

    def abort(self, messages) -> None:
        """Files that no list names are never read."""


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(path); df.write.format("warc").save(path)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_id_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def page_records(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """One record per page: the payload is the html in UTF-8 (null: empty).

    Of pages with equal payloads of at least ``least`` bytes that with the smallest page_id is the response,
    the others revisit it; smaller payloads are all responses. Repeated rows of the smallest page_id are all
    responses; a page without an id revisits any other. The shared digests are counted first and joined back,
    so a digest that a third of all pages share is split by the skew join.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    shared = p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = shared.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = p.join(shared, "payload_digest", "left")
    return joined.select(
        page_record_id(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(again, page_record_id(F.col("first"))).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Write the pages as archives below ``path`` (default: the shared folder); returns the path."""
    spark = pages.sparkSession
    register(spark)
    path = path or shared_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    return path


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages read back: digest and size of a response are taken from its payload, those of a revisit from its headers."""
    register(spark)
    # Each read has a reader of its own: predicates pushed into one must not reach the other.
    responses = spark.read.format("warc").load(path).filter("record_type = 'response'").select(
        "record_id", "record_type", "refers_to", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    revisits = spark.read.format("warc").load(path).filter("record_type = 'revisit'").select("record_id", "record_type", "refers_to", "payload_digest", "payload_bytes")
    both = responses.unionByName(revisits)
    return both.select(page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page_id_of(F.col("refers_to")).alias("refers_to"))
