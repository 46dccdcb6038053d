"""ARC files, their conversion to WARC, and reading both."""

import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from casewright.llm import warc


def sha(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows):
    """The contract in plain Python, for rows without null keys."""
    same, out = defaultdict(list), []
    for k, _, html in rows:
        same[(html or "").encode()].append(k)
    for body, keys in same.items():
        top = max(keys)
        for i, k in enumerate(sorted(keys, reverse=True)):
            out.append((k, len(body), sha(body), "response" if i == 0 else "revisit", None if i == 0 else top))
    return sorted(out, key=repr)


def test_archive_of_pages(spark):
    rows = [(1, "http://a/x y", "<p>é€😀</p>"), (2, None, None), (3, "http://b/ñ", ""), (4, "http://c", "same"), (9, "http://d", "same"), (5, "http://d", "same"), (5, "http://d", "same"), (7, "u", "WARC/1.1\r\n\r\nHTTP/1.0 200\r\n\r\nfiledesc://x 1 2 3 4\n"), (8, "u", "\n\n\r\n"), (10, "u", "long " * 300_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, record_type string, payload_bytes string")
    got = warc.archive(df.repartition(3)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(rows) and all(r["intact"] for r in got)
    assert len({r["record_id"] for r in got}) == len(rows) and {r["url"] for r in got if r["page_id"] == 1} == {"http://a/x%20y"}
    assert warc.archive(df.limit(0)).count() == 0


def test_null_keys_and_hot_payload(spark):
    rows = [(i, "u", "hot" if i % 2 else f"page {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted((tuple(r)[:5] for r in warc.archive(df).collect()), key=repr) == expected(rows)
    none = spark.createDataFrame([(None, "u", "x"), (None, "u", "x"), (3, "u", "x")], "page_id bigint, url string, html string")
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(none).collect()), key=repr) == [(3, "response", None), (None, "revisit", 3), (None, "revisit", 3)]


def test_files_roll_and_turn_versions(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "x" * 1000) for i in range(50)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_arc(df, str(tmp_path / "arc"), file_bytes=5000)
    files = sorted(tmp_path.glob("arc/*.gz"))
    heads = [gzip.open(f).read().split(b"\n")[1][:1] for f in files]
    assert len(files) == 13 and sorted(heads) == [b"1"] * 7 + [b"2"] * 6
    assert warc.read_arc(spark, str(tmp_path / "arc")).filter("type = 'response'").count() == 50
    got = [warc.timestamp(x) for x in ("19970203040506", "199702", "00001399256199")]
    assert got == ["1997-02-03T04:05:06Z", "1997-02-01T00:00:00Z", "0001-12-31T23:59:59Z"]


@pytest.mark.parametrize("version", [1, 2])
def test_foreign_files(spark, tmp_path, version):
    """Files that others wrote: members a record, bytes that are no UTF-8, DNS answers, spaces in URLs, a cut end."""
    page = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\n\xff\xfe\x00caf\xe9"
    body = f"{version} 0 someone\n{warc.ARC_FIELDS[version]}\n".encode()
    more = b"200 - - 0 f.arc " if version == 2 else b""
    line = lambda url, mime, doc, n=None: url + b" 1.2.3.4 19991231235959 " + mime + b" " + more + str(n or len(doc)).encode() + b"\n" + doc + b"\n"
    parts = [line(b"filedesc://f.arc", b"text/plain", body)[:-1] + b"\n", line(b"http://a/b c", b"text/html", page), b"\n", line(b"dns:a", b"text/dns", b"a. IN A 1.2.3.4"), line(b"ftp://a/f", b"application/octet-stream", b"\x00\x01"), line(b"http://z", b"text/html", page[:40], 900)]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "f.arc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = warc.read_arc(spark, str(tmp_path / "arc")).orderBy("offset").collect()
    assert [(r["type"], r["url"], r["date"]) for r in got] == [("warcinfo", "filedesc://f.arc", "1999-12-31T23:59:59Z"), ("response", "http://a/b c", "1999-12-31T23:59:59Z"), ("response", "dns:a", "1999-12-31T23:59:59Z"), ("resource", "ftp://a/f", "1999-12-31T23:59:59Z"), ("response", "http://z", "1999-12-31T23:59:59Z")]
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    back = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert all(r["intact"] for r in back) and {(r["page_key"], r["payload_digest"]) for r in back if r["page_key"]} == {(7, sha(page[33:])), (7, sha(page[33:40] + b"\n"))}
    assert {r["payload_digest"] for r in back if r["type"] == "resource"} == {sha(b"\x00\x01")}
