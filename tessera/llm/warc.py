"""Web archives: a converter from legacy ARC to WARC, and WARC files that Spark writes and reads.

ARC version 1 and 2 differ in the fields of their header lines; both declare each record's length, which
alone says where it ends. The converter gives each record a WARC identifier, timestamp, type and digests.

WARC files are written by Spark's text writer with the record separator of the format between rows, so a
lost task is written again by the usual commit, and are read whole and parsed by the declared lengths, so a
payload may hold the separator itself.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cluster

#: Fields of a header line by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
LEAST_PAYLOAD = 1000
#: Bytes of payload in a file, about: a reader holds a whole file.
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("0d5a7c52-5f0e-5c2b-9c1f-4a6b1f3a9e77")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    content: bytes
    version: int


def write_arc(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC block: the version record, then (url, ip, date, content type, content) records."""
    about = f"{version} 0 tessera\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = io.BytesIO()

    def line(url, ip, date, kind, length):
        if version == 1:
            return f"{url} {ip} {date} {kind} {length}\n".encode()
        return f"{url} {ip} {date} {kind} 200 - - {out.tell()} {name} {length}\n".encode()

    out.write(line(f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", len(about)) + about)
    for url, ip, date, kind, content in records:
        out.write(b"\n")
        out.write(line(url, ip, date, kind, len(content)))
        out.write(content)
    out.write(b"\n")
    return out.getvalue()


def parse_arc(block: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC block after its version record. Header lines are read by the version's fields from the right, as a URL may hold spaces."""
    at, version = 0, None
    while at < len(block):
        end = block.find(b"\n", at)
        if end < 0:
            break
        head = block[at:end].decode("utf-8", "replace").rstrip("\r")
        if not head:
            at = end + 1
            continue
        if version is None:
            start = end + 1
            about = block[start : start + int(head.rsplit(" ", 1)[1])]
            version = int(about.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            at = start + len(about)
            continue
        names = ARC_FIELDS[version]
        fields = dict(zip(names, head.rsplit(" ", len(names) - 1)))
        length = int(fields["Archive-length"])
        content = block[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"a record of {length} bytes ends after {len(content)}")
        yield ArcRecord(fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], content, version)
        at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header and payload of an HTTP response; other content is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def warc_date(arc_date: str) -> str:
    d = (arc_date + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(map(str, parts)))}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return " ".join(value.split())


def warc_record(page_id: int | None, r: ArcRecord, refers_to: int | None, origin: str | None = None) -> str:
    """The WARC record, without the separator after it; a revisit has no payload. A block that is not text comes as base64, and a header says so."""
    head, payload = split_http(r.content)
    digest = hashlib.sha1(payload).hexdigest()
    revisit = refers_to is not None
    block = head if revisit else r.content
    try:
        text, encoded = block.decode("utf-8"), False
    except UnicodeDecodeError:
        text, encoded = base64.b64encode(block).decode(), True
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id if origin is None else origin, digest)}",
        f"WARC-Date: {warc_date(r.date)}",
        f"WARC-Target-URI: {_clean(r.url)}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    if encoded:
        lines.append("X-Payload-Encoding: base64")
    kind = "application/http; msgtype=response" if head else _clean(r.content_type) or "application/octet-stream"
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(text.encode())}"]
    return "\r\n".join(lines) + "\r\n\r\n" + text


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a stream, by the declared lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip()] = value.strip()
        length = int(fields["Content-Length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"a record of {length} bytes ends after {len(block)}")
        yield fields, base64.b64decode(block) if fields.get("X-Payload-Encoding") == "base64" else block


def decide(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """(id, digest, refers_to) of the pages that revisit another: one row for each id and digest.

    Only ids and digests move. Of equal payloads of at least so many bytes, the largest id holds the payload.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least).select("id", "digest")
    held = narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return narrow.join(held, "digest").where("id is null or id < refers_to").select("id", "digest", "refers_to").distinct()


def write_pages(spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20240101000000", least: int = LEAST_PAYLOAD) -> None:
    """Write one WARC record for each row, by way of ARC blocks of either version and the converter.

    A null payload is empty, a null url is "about:blank". A record's identifier comes from id and digest, so
    reruns agree. Rows of the response's own id are responses too; a null id is smaller than any other.
    """
    cluster.ship(spark)
    told = cluster.materialize(spark, decide(pages, id_col, payload_col, least), "revisits").withColumnsRenamed({"id": "_id", "digest": "_digest"})
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")).alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"))
    rows = rows.join(told, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("id", "url", "html", "refers_to")

    def convert(batches):
        written = 0
        for k, batch in enumerate(batches):
            ids, refers = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for lo in range(0, len(ids), 256):
                records = []
                for url, html in zip(batch.column(1).slice(lo, 256).to_pylist(), batch.column(2).slice(lo, 256).to_pylist()):
                    body = html.encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    records.append((_clean(url), "0.0.0.0", date, "text/html", head + body))
                block = write_arc(records, 1 + (k + lo // 256) % 2)
                out = [warc_record(i, r, to) for i, to, r in zip(ids[lo : lo + 256], refers[lo : lo + 256], parse_arc(block), strict=True)]
                upto = written + np.cumsum([len(x) for x in out])
                written = int(upto[-1]) if len(upto) else written
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array((upto // FILE_BYTES).astype(np.int32))], ["value", "volume"])

    _write(rows.mapInArrow(convert, "value string, volume int"), path)


def _write(records: DataFrame, path: str) -> None:
    """Records (value, volume) as files of a volume each: a task's records go on to the next volume by their bytes, so no reader holds much more than FILE_BYTES and one record."""
    records.write.partitionBy("volume").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the ARC files (.arc, .arc.gz; a gzip member a record or a file) at or below path: file, place, version, url, ip, date, content_type, content.

    Files are read where Spark puts them, one at a time in a task. A file that ends within a record, or of an
    unknown version, is an error.
    """
    cluster.ship(spark)
    schema = "file string, place long, version int, url string, ip string, date string, content_type string, content binary"
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for k, r in enumerate(parse_arc(raw)):
                    rows.append((file, k, r.version, r.url, r.ip, r.date, r.content_type, r.content))
                    held += len(r.content)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{arc,arc.gz}").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def convert_arc(spark: SparkSession, arc_path: str, path: str) -> None:
    """The legacy archives at or below arc_path as WARC files below path: a response for each record, its identifier from file and place.

    A payload whose bytes are not UTF-8 is written as base64 with the header X-Payload-Encoding, as Spark's
    text writer takes text only; read_archives gives the bytes back.
    """
    cluster.ship(spark)

    def run(batches):
        written = 0
        for batch in batches:
            out, volumes = [], []
            for file, place, version, url, ip, date, kind, content in zip(*(batch.column(k).to_pylist() for k in range(8))):
                value = warc_record(None, ArcRecord(url, ip, date, kind, content, version), None, f"{file}#{place}")
                written += len(value)
                out.append(value), volumes.append(written // FILE_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(volumes, pa.int32())], ["value", "volume"])

    _write(read_arc(spark, arc_path).mapInArrow(run, "value string, volume int"), path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the WARC files below path: page_id, url, record_id, record_type, date, payload_bytes, payload_digest (hex), refers_to and payload (null for revisits).

    Payloads of responses are hashed again and must agree with the digest in the header.
    """
    cluster.ship(spark)
    schema = "page_id long, url string, record_id string, record_type string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_py())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows: list[tuple] = []
                held = 0
                for fields, block in parse_warc(stream):
                    revisit = fields["WARC-Type"] == "revisit"
                    payload = None if revisit else split_http(block)[1]
                    declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    digest = declared if revisit else hashlib.sha1(payload).hexdigest()
                    if digest != declared:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what was written")
                    rows.append(
                        (int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, fields["WARC-Target-URI"], fields["WARC-Record-ID"], fields["WARC-Type"], fields["WARC-Date"], int(fields["X-Payload-Length"]) if revisit else len(payload), digest, int(fields["X-Refers-To-Page"]) if revisit else None, payload)
                    )
                    held += len(block)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, schema)
