"""Legacy ARC archives to WARC, with duplicates as revisit records.

ARC: a version block (`filedesc://`) names version 1 (URL, address, date, type, length) or 2 (those
and result code, checksum, location, offset, file name); each record is one header line and as many
bytes as it declares. The converter reads files as whole binary values, follows the declared
lengths and makes WARC/1.1 records: ids are version-5 UUIDs of what identifies the record, 14-digit
stamps become ISO, the type follows from the block, digests are SHA-256 of payload and block.
Of equal payloads of at least `min_revisit` bytes the record with the smallest key is the response, the
others are revisits that carry its id and keep only their HTTP head.

Files are written by Spark's own writer to the shared folder (one row is one archive member of a few MB,
a few rows a file), so a lost executor's files are written again and any store that Spark reaches will do.
Payloads are shuffled once, when records meet their decision; the decision itself is made on digests, pre-aggregated.

Foreign archives: the record's address and declared content type go on into the WARC record; a version block becomes a warcinfo record; a key
header that is no 64-bit integer is a null key; a date that is not a real instant is 1970-01-01 and the record is marked as a problem, which
`read_arc` tells in its column `problem` and the WARC record in `X-Problem`; so is a block that ends before its declared length. A WARC record without
a length has none to go by: reading goes on at the next record. A payload that does not match its digest is marked as well.

Defined results: null payload or URL is empty; a key that is no 64-bit integer is null; a null key sorts after all others; equal keys are ordered by
place in the archive; empty input writes and reads nothing; a header line that does not parse is skipped up to the next line; a page that is larger
than a member is a member of its own, held whole by one task; other columns of the pages are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import fresh_path, materialise

MIN_REVISIT = 100
MEMBER_BYTES = 4_000_000
KEY_HEADER = "X-Record-Key"
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
_FIELD_LINE = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _members(pieces: Iterable[bytes], head: bytes = b"") -> Iterator[bytes]:
    """Pieces joined into archive members of about MEMBER_BYTES, each with `head` in front."""
    part, size = [], 0
    for p in pieces:
        part.append(p)
        size += len(p)
        if size >= MEMBER_BYTES:
            yield head + b"".join(part)
            part, size = [], 0
    if part:
        yield head + b"".join(part)


def _write(members: DataFrame, path: str, line_end: str) -> None:
    """Compressed at the fastest level: deflating took most of the time of writing."""
    out = members.select(F.col("member").cast("string")).write.option("lineSep", line_end).option("maxRecordsPerFile", 4)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def arc_block(version: int) -> bytes:
    body = f"{version} 0 tidemark\n{_FIELD_LINE[version]}\n".encode()
    rest = {1: "text/plain", 2: "text/plain 200 - - 0 archive.arc"}[version]
    return f"filedesc://archive.arc 0.0.0.0 20200101000000 {rest} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, key: int | None, url: str | None, payload: bytes | None, date: str = "20200101000000") -> bytes:
    payload = payload or b""
    mark = "" if key is None else f"{KEY_HEADER}: {key}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode()
    safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    middle = "" if version == 1 else " 200 - - 0 archive.arc"
    return f"{safe} 0.0.0.0 {date} text/html{middle} {len(head) + len(payload)}\n".encode() + head + payload + b"\n"


def write_arc(pages: DataFrame, version: int, key: str = "page_id", url: str = "url", payload: str = "html") -> str:
    """`pages` as ARC files in the shared folder; returns their folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for m in _members((arc_record(version, *r) for r in rows), arc_block(version)):
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1]], pa.binary())], names=["member"])  # the writer ends the line

    path = fresh_path(pages.sparkSession, f"arc{version}")
    src = pages.select(F.col(key).try_cast("bigint").alias("k"), F.col(url).cast("string").alias("u"), F.col(payload).cast("binary").alias("p"))
    _write(src.mapInArrow(run, "member binary"), path, "\n")
    return path


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, bytes], bytes, bool]]:
    """(offset, header fields, block, whole) of every record and version block; version blocks switch the header's fields."""
    fields, at = ARC_FIELDS[1], 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end]
        version_block = line.startswith(b"filedesc://")
        names = fields
        if version_block:
            names = ARC_FIELDS[2 if len(line.split()) >= len(ARC_FIELDS[2]) else 1]
        parts = line.rsplit(b" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            at = end + 1
            continue
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if version_block:
            fields = ARC_FIELDS[2 if block[:1] == b"2" else 1]
        yield at, dict(zip(names, parts, strict=True)), block, len(block) == length
        at = end + 1 + length
        if data[at : at + 1] == b"\n":
            at += 1


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload); everything is payload if the block is no HTTP message."""
    if block.startswith(b"HTTP/"):
        cut = block.find(b"\r\n\r\n")
        if cut >= 0:
            return block[: cut + 4], block[cut + 4 :]
    return b"", block


def http_field(head: bytes, name: str) -> bytes | None:
    m = re.search(rb"(?mi)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1] if m else None


def record_id(url: str, date: str, file: str, offset: int, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {file}:{offset} {digest}')}"


def iso_date(stamp: str) -> str | None:
    """ISO form of a stamp of up to 14 digits, missing ones at their start; None if it names no instant."""
    s = (stamp + "00000101000000"[len(stamp) :])[:14]
    try:
        return datetime.strptime(s, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ") if re.fullmatch("[0-9]{4,14}", stamp) else None
    except ValueError:
        return None


def _key(raw: bytes | None) -> int | None:
    found = re.fullmatch(rb"[+-]?[0-9]{1,19}", (raw or b"").strip())
    n = int(found[0]) if found else None
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(paths).select("path", "content")


_RECORD = "file string, offset bigint, key bigint, id string, url string, date string, type string, payload_bytes bigint, payload_digest string, ip string, content_type string, problem string"


def read_arc(spark: SparkSession, paths: list[str], with_block: bool) -> DataFrame:
    """One row per ARC record, ready for WARC; the block itself only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, rows, size = path.rsplit("/", 1)[-1], [], 0
                for offset, head, block, whole in parse_arc(gzip.decompress(content)):
                    info = head["url"].startswith(b"filedesc://")
                    http, payload = (b"", block) if info else split_http(block)
                    digest = hashlib.sha256(payload).hexdigest()
                    url, stamp, ip, declared = (head[f].decode("utf-8", "replace") for f in ("url", "date", "ip", "type"))
                    date = iso_date(stamp)
                    problem = ", ".join(w for w, bad in (("date", date is None), ("length", not whole)) if bad) or None
                    kind = "warcinfo" if info else "response" if http else "resource"
                    rows.append((name, offset, _key(http_field(http, KEY_HEADER)), record_id(url, stamp, name, offset, digest), url, date or "1970-01-01T00:00:00Z", kind, len(payload), digest, ip, declared, problem, *([block] if with_block else [])))
                    size += len(block)
                    if size >= MEMBER_BYTES:
                        yield _batch(rows, with_block)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, with_block)

    return _files(spark, paths).mapInArrow(run, _RECORD + ", block binary" * with_block)


def _batch(rows: list[tuple], with_block: bool) -> pa.RecordBatch:
    names = [f.split()[0] for f in _RECORD.split(", ")] + ["block"] * with_block
    types = [{"bigint": pa.int64(), "string": pa.string()}[f.split()[1]] for f in _RECORD.split(", ")] + [pa.binary()] * with_block
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def decide(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(file, offset, refers_id, refers_url, refers_date) of the records that revisit another."""
    order = F.struct(F.col("key").isNull().alias("n"), "key", "file", "offset", "id", "url", "date")
    first = (
        records.where((F.col("payload_bytes") >= min_revisit) & (F.col("type") != "warcinfo"))
        .groupBy("payload_digest")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("payload_digest", F.col("first.id").alias("refers_id"), F.col("first.url").alias("refers_url"), F.col("first.date").alias("refers_date"))
    )
    return records.where("type <> 'warcinfo'").join(first, "payload_digest").where("id <> refers_id").select("file", "offset", "refers_id", "refers_url", "refers_date")


def warc_record(r: dict) -> bytes:
    """One record, without the last line end (the writer's)."""
    block, kind = r["block"], r["type"]
    lines = [("WARC-Record-ID", f"<{r['id']}>"), ("WARC-Date", r["date"]), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}")]
    lines += [("WARC-Filename", r["file"])] if kind == "warcinfo" else [("WARC-Target-URI", r["url"])]
    if r["refers_id"]:
        kind, block = "revisit", split_http(block)[0]
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{r['refers_id']}>"),
            ("WARC-Refers-To-Target-URI", r["refers_url"]),
            ("WARC-Refers-To-Date", r["refers_date"]),
        ]
    lines += [("WARC-IP-Address", r["ip"])] if r["ip"] not in ("", "-", "0.0.0.0") else []
    lines += [("X-Declared-Content-Type", r["content_type"])] if r["type"] == "response" else []
    lines += [("X-Problem", r["problem"])] if r["problem"] else []
    lines += [
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response" if r["type"] == "response" else r["content_type"]),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *lines])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def convert(spark: SparkSession, arc_paths: list[str], min_revisit: int = MIN_REVISIT) -> str:
    """ARC folders to a folder of WARC files."""
    index = materialise(read_arc(spark, arc_paths, with_block=False), "arc-index")
    # The index and its few revisits are written tables: their sizes are known when the joins are planned.
    revisits = materialise(decide(index, min_revisit), "revisits")
    records = read_arc(spark, arc_paths, with_block=True).join(revisits, ["file", "offset"], "left")
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(names, r, strict=True)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for m in _members(map(warc_record, rows)):
            yield pa.RecordBatch.from_arrays([pa.array([m[:-2]], pa.binary())], names=["member"])

    path = fresh_path(spark, "warc")
    _write(records.mapInArrow(run, "member binary"), path, "\r\n")
    return path


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0:
            return
        head = {}
        for line in data[at:cut].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        length = head.get("content-length", "")
        if not re.fullmatch("[0-9]+", length):
            at = cut + 4
            continue
        yield head, data[cut + 4 : cut + 4 + int(length)]
        at = cut + 4 + int(length)


_READ = "id string, refers_id string, record_type string, url string, date string, key bigint, payload_bytes bigint, payload_digest string, problem string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record; the payload length of a revisit comes from its archived HTTP head."""
    strip = lambda x: x.strip("<>") if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1).to_pylist():
                rows = []
                for head, block in parse_warc(gzip.decompress(content)):
                    http, payload = split_http(block)
                    kind, told, problem = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha256:"), head.get("x-problem")
                    if kind == "warcinfo":
                        continue
                    if kind == "revisit":
                        size, digest = _key(http_field(http, "Content-Length")) or 0, told
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if told != digest:
                            problem = ", ".join(filter(None, [problem, "digest"]))
                    rows.append((strip(head.get("warc-record-id")), strip(head.get("warc-refers-to")), kind, head.get("warc-target-uri"), head.get("warc-date"), _key(http_field(http, KEY_HEADER)), size, digest, problem))
                if rows:
                    names = [f.split()[0] for f in _READ.split(", ")]
                    types = [{"bigint": pa.int64(), "string": pa.string()}[f.split()[1]] for f in _READ.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return _files(spark, [path]).mapInArrow(run, _READ)
