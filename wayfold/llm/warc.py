"""Legacy archives: ARC files, version 1 and 2, read by their declared lengths and converted to WARC.

An ARC file begins with a version block (filedesc://), whose second line names the fields of the header lines that follow: five in
version 1, ten in version 2. A header line is cut from the right, for old crawlers left blanks in URLs; the last field is the
length of the network document. Conversion gives each record a WARC identifier (a name-based UUID of key, URL and date), the
date in ISO form, a type and SHA-1 digests of block and payload. Of records with equal payloads of at least LEAST bytes, that
with the largest key is a response and the others revisit it.

Files are written by Spark's text writer, record for line (the line end of a WARC record is CRLF CRLF), gzipped as a whole,
so they are committed as any Spark output and go to any file system.

Defined results: a null payload is an empty one; a null URL is about:blank; white space in URLs is percent-encoded; a null key is kept as no
key, and such a record is a response only if no equal payload has one; repeated rows are records of their own, and the one
identifier they share is a response in each; bytes that an ARC file lacks make a record truncated, not lost; damage (a line that is no header, a length that is no number, a broken
compression, a WARC record without a header it needs or with too few bytes) is a row with an error, and reading goes on at the next record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, work_path

LEAST = 1000
# The version blocks of ARC files and the revisit profile of WARC.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = "X-Source-Key"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "wayfold:arc")
EPOCH = datetime(2004, 1, 1)
FLUSH = 8 << 20

ARC_SCHEMA = "key long, url string, ip string, date string, content_type string, arc_version int, http binary, payload binary, payload_bytes long, payload_digest string, truncated boolean, error string"
WARC_SCHEMA = "record_type string, record_id string, url string, date string, key long, refers_to long, refers_to_id string, payload_bytes long, payload_digest string, sound boolean, error string"


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weigh) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about FLUSH bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + weigh(row)
        if weight >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def clean_url(url: str | None) -> str:
    return "".join(f"%{b:02X}" if b <= 0x20 or b == 0x7F else chr(b) if b < 0x80 else f"%{b:02X}" for b in (url or "about:blank").encode())


# --- ARC


def arc_record(version: int, key: int | None, url: str | None, payload: bytes) -> bytes:
    """A header line and a network document; the date comes from the key, as the tables have none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    http += (f"{KEY_HEADER}: {key}\r\n" if key is not None else "") + "\r\n"
    body = http.encode() + payload
    date = (EPOCH + timedelta(seconds=(key or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
    extra = f" 200 {hashlib.sha1(body).hexdigest()} - 0 -" if version == 2 else ""
    return f"{clean_url(url)} 0.0.0.0 {date} text/html{extra} {len(body)}\n".encode() + body


def version_block(version: int, name: str) -> bytes:
    about = f"{version} 0 wayfold\n{ARC_FIELDS[version]}\n"
    extra = " 0 - - 0 -" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20040101000000 text/plain{extra} {len(about)}\n{about}".encode()


def write_arc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """ARC files of the rows of `pages`, one for each partition, of version 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def rows():
            yield (version_block(version, f"part-{part:05d}.arc"),)
            for batch in batches:
                for k, u, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    yield (arc_record(version, k, u, p or b""),)

        yield from _batches(rows(), ["value"], [pa.binary()], lambda r: len(r[0]))

    chosen = pages.select(F.col(key).cast("long"), F.col(url), F.col(payload).cast("binary"))
    chosen.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").text(path)


def _length(value: str) -> int:
    if not value.isascii() or not value.isdigit():
        raise ValueError(f"no length: {value[:20]!r}")
    return int(value)


def arc_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an ARC file: its header fields by name, version, body, and whether the file ends within it. Where a header line is expected and there is none, one record has an error alone,
    and lines are passed over until the next that is one."""
    version, fields, lost = 1, ARC_FIELDS[1].split(), False
    while line := stream.readline():
        line = line.strip(b"\r\n")
        if not line:
            continue
        try:
            if line.startswith(b"filedesc://"):
                about = stream.read(_length(line.rsplit(b" ", 1)[-1].decode("latin-1"))).split(b"\n")
                if len(about) < 2 or b"Archive-length" not in about[1].split():
                    raise ValueError("a version block without its fields")
                version, fields, lost = int(about[0].split(b" ")[0]), about[1].decode("utf-8", "replace").split(), False
                continue
            record = dict(zip(fields, line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1), strict=True))
            length = _length(record["Archive-length"])
        except ValueError as wrong:
            if not lost:
                yield {"error": f"{wrong} in {line[:40]!r}"}
            lost = True
            continue
        lost = False
        body = stream.read(length)
        yield record | {"version": version, "body": body, "truncated": len(body) < length, "error": None}


def until_damage(records: Iterator, lost: Callable[[str], object]) -> Iterator:
    """`records`, and lost(what is wrong) where their file can't be unpacked further."""
    try:
        yield from records
    except (EOFError, OSError, zlib.error) as wrong:
        yield lost(f"{type(wrong).__name__}: {wrong}")


HTTP_END = re.compile(rb"\r?\n\r?\n")


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Headers with the blank line, and payload; all payload if there is no HTTP status line."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = HTTP_END.search(body)
    return (body, b"") if end is None else (body[: end.end()], body[end.end() :])


def http_value(http: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", http)
    return found and found[1].decode("latin-1").strip()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _opened(raw: pa.Scalar) -> io.BufferedIOBase:
    data = pa.BufferReader(raw.as_buffer())
    zipped = data.read(2) == b"\x1f\x8b"
    data.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=data) if zipped else data, 1 << 16)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the ARC files below `path`, gzipped or not; what isn't a record is a row with an error, whose other columns are null but for an empty payload."""
    names = [x.split()[0] for x in ARC_SCHEMA.split(", ")]
    types = [pa.int64(), *[pa.string()] * 4, pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for raw in batch.column(0):
                    for r in until_damage(arc_records(_opened(raw)), lambda wrong: {"error": wrong}):
                        if r["error"] is not None:
                            yield (*[None] * 5, None, None, b"", None, None, None, r["error"])
                            continue
                        http, payload = split_http(r["body"])
                        key = http_value(http, KEY_HEADER)
                        whole = key is not None and re.fullmatch(r"-?[0-9]{1,18}", key)
                        yield (int(key) if whole else None, r.get("URL", "about:blank"), r.get("IP-address", "0.0.0.0"), r.get("Archive-date", ""), r.get("Content-type"), r["version"], http, payload, len(payload), hashlib.sha1(payload).hexdigest(), r["truncated"], None)

        yield from _batches(rows(), names, types, lambda r: len(r[7]))

    return _files(spark, path).mapInArrow(run, ARC_SCHEMA)


# --- WARC


def warc_date(arc_date: str) -> str:
    """An ARC date of 14 digits (or of 12 or 8, as early files have) in ISO form."""
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: int | None, url: str, date: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key} {date} {url}')}>"


def _digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record but for the two line ends that close it."""
    lines = [*headers, ("WARC-Block-Digest", _digest(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block


def with_originals(records: DataFrame, least: int = LEAST) -> DataFrame:
    """`records` with original, the key, URL and date of the response that a record revisits (null for responses).

    Digests that occur once are left out before the join; a digest of very many records is a skewed key of a join that
    adaptive execution splits, and only the records' side is large.
    """
    place = F.struct("key", "url", "date")
    groups = records.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max(place).alias("original"), F.count("*").alias("n"))
    found = records.join(groups.filter("n > 1").drop("n"), "payload_digest", "left")
    return found.withColumn("original", F.when(~place.eqNullSafe(F.col("original")) & (F.col("payload_bytes") >= least), F.col("original")))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of ARC records that have their originals."""
    columns = ["key", "url", "ip", "date", "http", "payload", "payload_digest", "original", "truncated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            part = TaskContext.get().partitionId()
            about = f"software: wayfold\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC, part {part}\r\n".encode()
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, f"warcinfo:{part}", "")), ("WARC-Date", warc_date("20040101")), ("Content-Type", "application/warc-fields")]
            yield (warc_record(info, about),)
            for batch in batches:
                for key, url, ip, date, http, payload, digest, original, cut in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    headers = [
                        ("WARC-Type", "response" if original is None else "revisit"),
                        ("WARC-Record-ID", record_id(key, url, date)),
                        ("WARC-Date", warc_date(date)),
                        ("WARC-Target-URI", url),
                        ("WARC-IP-Address", ip),
                        ("Content-Type", "application/http; msgtype=response" if http else "application/octet-stream"),
                        ("WARC-Payload-Digest", _digest(digest)),
                        (f"{KEY_HEADER}-Length", str(len(payload))),
                    ]
                    if key is not None:
                        headers.append((KEY_HEADER, str(key)))
                    if cut:
                        headers.append(("WARC-Truncated", "unspecified"))
                    if original is not None:
                        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original["key"], original["url"], original["date"])), ("WARC-Refers-To-Target-URI", original["url"]), ("WARC-Refers-To-Date", warc_date(original["date"]))]
                        if original["key"] is not None:
                            headers.append((f"{KEY_HEADER}-Refers-To", str(original["key"])))
                    yield (warc_record(headers, http if original is not None else http + payload),)

        yield from _batches(rows(), ["value"], [pa.binary()], lambda r: len(r[0]))

    records.select(*columns).mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, by lower-case name, and block of each record. Where a record is expected and there is none, or one without a length, the headers are {"error": what is wrong}, and lines are
    passed over until the next record."""
    lost = False
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            if not lost:
                yield {"error": f"no WARC record: {line[:40]!r}"}, b""
            lost = True
            continue
        headers, lost = {}, False
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        try:
            length = _length(headers.get("content-length", ""))
        except ValueError as wrong:
            yield {"error": str(wrong)}, b""
            lost = True
            continue
        block = stream.read(length)
        yield (headers, block) if len(block) == length else ({"error": f"{length} bytes declared, {len(block)} left"}, b"")


def _warc_row(headers: dict[str, str], block: bytes) -> tuple:
    """A response or revisit record as a row of WARC_SCHEMA."""

    def number(name: str) -> int | None:
        found = headers.get(name.lower())
        return None if found is None else int(found)

    kind = headers["warc-type"]
    told = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    size, digest = number(f"{KEY_HEADER}-Length"), told
    sound = _digest(hashlib.sha1(block).hexdigest()) == headers["warc-block-digest"]
    if kind == "response":
        payload = split_http(block)[1]
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        sound &= digest == told
    return (kind, headers["warc-record-id"], headers.get("warc-target-uri"), headers["warc-date"], number(KEY_HEADER), number(f"{KEY_HEADER}-Refers-To"), headers.get("warc-refers-to"), size, digest, sound, None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of the WARC files below `path`. Digest and size of responses come from the stored payload, those of
    revisits from the headers; sound tells whether digests of the stored bytes are those of the headers. What isn't a record, or lacks a header, is a row with an error alone."""
    names = [x.split()[0] for x in WARC_SCHEMA.split(", ")]
    types = [*[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for raw in batch.column(0):
                    for headers, block in until_damage(warc_records(_opened(raw)), lambda wrong: ({"error": wrong}, b"")):
                        if "error" in headers:
                            yield (*[None] * 10, headers["error"])
                        elif headers.get("warc-type") in ("response", "revisit"):
                            try:
                                row = _warc_row(headers, block)
                            except (KeyError, ValueError) as wrong:
                                row = (*[None] * 10, f"{type(wrong).__name__}: {wrong}")
                            yield row

        yield from _batches(rows(), names, types, lambda r: 200)

    return _files(spark, path).mapInArrow(run, WARC_SCHEMA)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> None:
    """WARC files of the ARC files below `arc_path`; what isn't a record there has none here."""
    write_warc(with_originals(read_arc(spark, arc_path).filter("error IS NULL"), least), warc_path)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: written as ARC, converted to WARC, and read back."""
    arcs, warcs = work_path(spark, "arc"), work_path(spark, "warc")
    write_arc(read_table(spark, sf_dir, "pages"), arcs)
    convert(spark, arcs, warcs)
    found = read_warc(spark, warcs).filter("error IS NULL")
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d FROM p),
r AS (SELECT page_id, n, d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS o FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o <> page_id THEN o END AS refers_to
FROM r
"""
