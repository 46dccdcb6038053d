"""Web archives: legacy ARC files, their conversion to WARC, and reading both.

An ARC file begins with a version block that names the fields of its URL-record lines: five in version 1, ten in
version 2. Each line ends with the declared length of the document after it, so a file is walked from line to line.
The converter gives every ARC record what WARC asks for and ARC lacks: an identifier (from the file's name and the
record's offset, so a repeated task writes the same one), a W3C timestamp, a type, and digests. Files are rows: each is
written by Spark's text sink and read whole by the binary source, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.shared import checkpoint_dir, lookup, stage_table

# The field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# Fixed value: the profile of a record whose payload another record holds.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32 << 20
PRINTABLE = "".join(map(chr, range(33, 127)))
KEY_HEADER = "X-Page-Id"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _write(files: DataFrame, path: str, end: str) -> None:
    """One compressed file for each row's bytes; `end` is the separator that the sink puts after a row."""
    files.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", end).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    source = spark.read.format("binaryFile").load(path)
    return source.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def plain(content: bytes) -> bytes:
    """Decompressed, if it is compressed; archives may be one member a file or one a record."""
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(content) + d.flush())
        content = d.unused_data
    return b"".join(out) if out else content


def arc_file(records: list[tuple], version: int, number: int, date: str) -> bytes:
    """An ARC file of records (url, ip, date, mime, status, document) without its last line break."""
    name = f"pages-{number:05d}-v{version}.arc"
    body = f"{version} 0 casewright\n{ARC_FIELDS[version]}\n".encode()
    extra = f"200 - - 0 {name} " if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(body)}\n".encode() + body]
    offset = len(out[0]) + 1
    for url, ip, when, mime, status, document in records:
        extra = f"{status} {sha1_base32(document)} - {offset} {name} " if version == 2 else ""
        line = f"{url} {ip} {when} {mime} {extra}{len(document)}\n".encode()
        out.append(line + document)
        offset += len(line) + len(document) + 1
    return b"\n".join(out)


def write_arc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "19970101000000", file_bytes: int = FILE_BYTES) -> None:
    """Write pages as ARC files under `path`, by turns of version 1 and 2; runs when called.

    A document is an HTTP response with the page's key as a header and the payload in UTF-8 (null: empty). A file ends
    when it has `file_bytes`; a longer page is a file of its own. Extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"content": pa.array([arc_file(held, 1 + number % 2, number, date)], pa.binary())})

        for batch in batches:
            for k, u, body in zip(*(c.to_pylist() for c in batch.columns)):
                body = body or b""
                head = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{KEY_HEADER}: {k}\r\n" if k is not None else "") + f"Content-Length: {len(body)}\r\n\r\n"
                held.append((quote(u, safe=PRINTABLE) if u else "-", "0.0.0.0", date, "text/html", 200, head.encode() + body))
                size += len(body) + 300
                if size >= file_bytes:
                    yield flush()
                    held, size, number = [], 0, number + 1
        if held:
            yield flush()

    rows = pages.select(F.col(key).cast("string").alias("k"), F.col(url).alias("u"), F.encode(F.col(payload), "UTF-8").alias("p"))
    _write(rows.mapInArrow(run, "content binary"), path, "\n")


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of one ARC file: (offset, url, ip, date, mime, status, document, whole); whole is false where the
    file ends before the declared length. The version block is the first record; its second line names the fields."""
    at, width, default_date = 0, 5, "19700101000000"
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            return
        line = content[at:end].decode("utf-8", "replace").strip()
        if not line:
            at = end + 1
            continue
        first = line.startswith("filedesc://")
        if first:  # either version: the last field is the length, whatever stands before it
            fields = line.split(" ")
            named = content[end + 1 :].split(b"\n", 2)[1:2]
            width = len(named[0].split()) if named and named[0].startswith(b"URL ") else 5
        else:  # a malformed URL may hold spaces, so fields are counted from the right
            fields = line.rsplit(" ", width - 1)
        if len(fields) < 5 or not fields[-1].isdigit():
            at = end + 1  # no URL-record line: look for the next
            continue
        length, start = int(fields[-1]), end + 1
        default_date = fields[2] if first else default_date
        yield {
            "offset": at, "url": fields[0], "ip": fields[1], "date": fields[2] if fields[2].isdigit() else default_date, "mime": fields[3],
            "status": int(fields[4]) if width == 10 and fields[4].isdigit() else None, "document": content[start : start + length], "whole": start + length <= len(content),
        }
        at = start + length


def timestamp(date: str) -> str:
    """A W3C timestamp of up to 14 digits; missing or impossible parts take their least value."""
    digits = (date + "0" * 14)[:14]
    least = [max(int(digits[a:b]), low) for a, b, low in ((0, 4, 1), (4, 6, 1), (6, 8, 1), (8, 10, 0), (10, 12, 0), (12, 14, 0))]
    y, mo, d, h, mi, s = (min(x, high) for x, high in zip(least, (9999, 12, 31, 23, 59, 59)))
    return f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}Z"


def split_http(document: bytes) -> tuple[bytes, bytes] | None:
    """(header with its blank line, payload) of an HTTP response, or None."""
    if not document.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", document)
    return (document[: m.end()], document[m.end() :]) if m else (document, b"")


def _header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m.group(1).decode("utf-8", "replace").strip() if m else None


RECORD = "file string, offset bigint, record_id string, url string, date string, mime string, type string, head binary, page_key bigint, payload binary, payload_bytes bigint, payload_digest string"


def read_arc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of ARC files as WARC sees them: (file, offset, record_id, url, date, mime, type, head, page_key,
    payload, payload_bytes, payload_digest).

    type: warcinfo for version blocks, response for HTTP responses and DNS answers, resource for other documents. head:
    the HTTP header; page_key: its page header as a number, or null. payloads=False leaves head and payload null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("type", pa.string()), ("head", pa.binary()), ("page_key", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for r in arc_records(plain(content.as_py())):
                    http = split_http(r["document"])
                    head, body = http or (b"", r["document"])
                    known = _header(head, KEY_HEADER)
                    rows.append({
                        "file": name, "offset": r["offset"], "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{r['offset']}')}>", "url": r["url"], "date": timestamp(r["date"]), "mime": r["mime"],
                        "type": "warcinfo" if r["url"].startswith("filedesc://") else "response" if http or r["url"].startswith("dns:") else "resource", "head": head if payloads else None,
                        "page_key": int(known) if known and re.fullmatch(r"-?[0-9]{1,19}", known) else None, "payload": body if payloads else None, "payload_bytes": len(body), "payload_digest": sha1_base32(body),
                    })
                    size += len(body) if payloads else 100
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return _files(spark, path).mapInArrow(run, RECORD)


def warc_record(r: dict) -> bytes:
    """One WARC record without its two closing line breaks."""
    head, body, revisit = r["head"] or b"", r["payload"] or b"", r["refers_to"] is not None
    if r["type"] == "warcinfo":
        body = f"software: casewright\r\nformat: WARC File Format 1.1\r\nconverted-from: {r['file']}\r\n".encode() + body
    block = head if revisit else head + body
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else r['type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}"]
    if r["type"] != "warcinfo":
        lines += [f"WARC-Target-URI: {r['url']}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}"]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {r['refers_to']}", f"WARC-Refers-To-Target-URI: {r['refers_url']}", f"WARC-Refers-To-Date: {r['refers_date']}", f"WARC-Identified-Payload-Length: {r['payload_bytes']}"]
    kind = "application/warc-fields" if r["type"] == "warcinfo" else "application/http; msgtype=response" if head else r["mime"]
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def convert(spark: SparkSession, arc: str, warc: str, *, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Convert the ARC files under `arc` to WARC files under `warc`; runs when called.

    Of response records with equal payloads of `least_bytes` or more, the one with the largest page key (then record id)
    stays a response; the others become revisits of it, without the payload. A pass over the digests alone finds
    repeated payloads; payloads are shuffled only where there are too many of those for a broadcast.
    """
    small = stage_table(read_arc(spark, arc, payloads=False).filter("type = 'response'").select("record_id", "url", "date", "page_key", "payload_bytes", "payload_digest"), "arc-index")
    best = F.max_by(F.struct("record_id", "url", "date"), F.struct("page_key", "record_id")).alias("r")
    groups = small.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(best, F.count("*").alias("n")).filter("n > 1")
    repeated = stage_table(groups.select("payload_digest", F.col("r.record_id").alias("chosen"), F.col("r.url").alias("chosen_url"), F.col("r.date").alias("chosen_date"), "n"), "arc-repeats")
    records = lookup(read_arc(spark, arc), repeated, "payload_digest", small.count(), F.col("record_id"))
    again = (F.col("type") == "response") & (F.col("chosen") != F.col("record_id"))
    told = records.select("file", "offset", "record_id", "url", "date", "mime", "type", "head", F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", *(F.when(again, F.col(f"chosen{c}")).alias(f"refers_{d}") for c, d in (("", "to"), ("_url", "url"), ("_date", "date"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"content": pa.array([b"\r\n\r\n".join(held)], pa.binary())})

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                for r in batch.slice(i, 200).to_pylist():
                    held.append(warc_record(r))
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    _write(told.mapInArrow(run, "content binary"), warc, "\r\n\r\n")


def warc_records(content: bytes) -> Iterator[dict]:
    """(offset, fields, block) of one WARC file, walked by the declared lengths; field names are lower case."""
    at = 0
    while True:
        at = content.find(b"WARC/", at)
        end = content.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        length = int(fields.get("content-length", "0"))
        yield {"offset": at, "fields": fields, "block": content[start : start + length]}
        at = start + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record_id, type, url, date, refers_to, page_key, payload_bytes, payload_digest, intact) of WARC files.

    Size and digest of a payload are measured where the record holds it, and are those declared where it is a revisit;
    intact: the block has its declared digest and the payload too.
    """
    names = ["file", "offset", "record_id", "type", "url", "date", "refers_to", "page_key", "payload_bytes", "payload_digest", "intact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for r in warc_records(plain(content.as_py())):
                    f, block = r["fields"], r["block"]
                    http = split_http(block)
                    head, body = http or (b"", block)
                    bare = lambda x: f.get(x, "").removeprefix("sha1:")  # noqa: E731, B023
                    revisit = f.get("warc-type") == "revisit"
                    size = int(f.get("warc-identified-payload-length") or _header(head, "Content-Length") or 0) if revisit else len(body)
                    digest = bare("warc-payload-digest") if revisit else sha1_base32(body)
                    intact = bare("warc-block-digest") == sha1_base32(block) and (f.get("warc-type") == "warcinfo" or bare("warc-payload-digest") == digest)
                    known = _header(head, KEY_HEADER)
                    rows.append((name, r["offset"], f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-refers-to"), int(known) if known else None, size, digest, intact))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=names)

    return _files(spark, path).mapInArrow(run, "file string, offset bigint, record_id string, type string, url string, date string, refers_to string, page_key bigint, payload_bytes bigint, payload_digest string, intact boolean")


def archive(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, url, record_id, intact) of pages that went through ARC
    files and their conversion, as read back from the WARC files; both are written under the shared folder at once.

    key is a whole number or null (a null key is the smallest; nothing refers to it by number). Null payloads are empty;
    equal rows are records of their own, of which one is the response. Columns beside the three named don't matter. An
    empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_arc(pages, f"{folder}/arc", key=key, url=url, payload=payload)
    convert(spark, f"{folder}/arc", f"{folder}/warc", least_bytes=least_bytes)
    found = stage_table(read_warc(spark, f"{folder}/warc").filter("type <> 'warcinfo'"), "warc-index")
    asked = found.filter("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n"))
    held = found.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_key").alias("of"))
    named = stage_table(asked.join(held, "refers_to"), "warc-responses")
    known = lookup(found, named, "refers_to", found.count(), F.col("record_id"))
    return known.select(F.col("page_key").alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("of").alias("refers_to"), "url", "record_id", "intact")
