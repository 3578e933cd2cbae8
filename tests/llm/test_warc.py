"""WARC archives: what is read back against plain digests, damaged archives, odd rows."""

import base64
import gzip
import hashlib
import io
import random

import pytest

from tests.compare import assert_same, duck, rows_of
from vectide.llm import registry, warc

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.seconds(90)
SCHEMA = "page_id long, url string, html string, key string, refers_to string, file string"


def sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_against_sql(spark):
    assert_same(rows_of(registry.op11_warc_roundtrip(spark, SF)), duck(SF, warc.ORACLE, ["pages"]))


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefgh <>") for _ in range(3 << 20))
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "", ""), (5, "http://c/\r\nWARC-Type: evil x", "ünï\r\n\r\ncode"), (6, "u", long), (7, "u", long), (7, "u", long), (None, "n", "same"), (None, "m", "alone"), (8, "v", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url, r.verified) for r in warc.archived_pages(spark, df).collect()), key=str)
    top = {"same": 2, "": 4, long: 7}
    wanted = []
    for page, url, html in rows:
        b = (html or "").encode()
        other = top.get(html or "") if top.get(html or "") != page else None
        url = url and url.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
        wanted.append((page, len(b), sha(b), "revisit" if other else "response", other, url, True))
    assert got == sorted(wanted, key=str)
    longer = warc.archived_pages(spark, df, min_revisit_bytes=5).collect()
    assert [r.refers_to for r in longer if r.record_type == "revisit"] == [7]
    assert warc.archived_pages(spark, df.limit(0)).count() == 0


def test_many_archives_with_payloads(spark, tmp_path):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(concat('text ', id div 3), 50) as html")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=2000)
    assert manifest.count() > 8 and manifest.selectExpr("sum(records)").first()[0] == 300
    found = warc.read_archives(manifest).collect()
    assert sum(r.record_type == "warcinfo" for r in found) == manifest.count() and all(r.problem is None for r in found)
    by_id = {r.record_id: r for r in found}
    for i in range(300):
        r = by_id[f"<urn:page:{i}>"]
        assert r.payload_digest == sha((f"text {i // 3}" * 50).encode()) and r.uri == f"http://x/{i}"
        assert (r.payload, r.refers_to) == ((f"text {i // 3}" * 50).encode(), None) if i % 3 == 2 else (None, f"<urn:page:{i // 3 * 3 + 2}>")
    # a member starts at each offset, and any gzip reader can read the file
    r = by_id["<urn:page:299>"]
    whole = open(r.file.removeprefix("file://"), "rb").read()
    assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == sum(x.file == r.file for x in found)
    assert gzip.GzipFile(fileobj=io.BytesIO(whole[r.offset :])).read().startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:299>")


def test_copies_too_many_to_broadcast(spark, monkeypatch):
    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "if(id < 70, 'hot', concat('h', id div 2)) as html")
    few = sorted(map(tuple, warc.marked_copies(pages).select("page_id", "refers_to").collect()))
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, warc.marked_copies(pages).select("page_id", "refers_to").collect())) == few
    assert dict(few)[0] == 69 and dict(few)[69] is None and dict(few)[100] == 101


def archive(payloads, pieces=1) -> bytes:
    out = io.BytesIO()
    for i, p in enumerate(payloads):
        warc._member(out, warc._page_record(i, "u", memoryview(p), None, None, "2000-01-01T00:00:00Z"), 6)
    return out.getvalue()


class Trickle(io.BytesIO):
    """Gives a few bytes at a time, whatever is asked for."""

    def read(self, n=-1):
        return super().read(7)


def test_reader_on_damaged_archives():
    payloads = [b"", b"one", b"x" * 2_000_000, bytes(range(256)) * 40]
    good = archive(payloads)
    for stream in (io.BytesIO(good), Trickle(good[:5000])):
        found = list(warc.records(stream))
        assert [r.payload for r in found if r.problem is None] == payloads[: len([r for r in found if r.problem is None])]
    assert [r.problem for r in warc.records(io.BytesIO(good))] == [None] * 4
    assert list(warc.records(io.BytesIO(b""))) == []
    cut = list(warc.records(io.BytesIO(good[:-20])))
    assert len(cut) == 4 and cut[-1].problem and not cut[-1].fields
    for junk in (b"no archive", gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")):
        assert [bool(r.problem) for r in warc.records(io.BytesIO(junk))] == [True]
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n%s\r\nabc%s"
    whole = [(b"WARC-Block-Digest: sha1:" + sha(b"abc").encode() + b"\r\n", b"\r\n\r\n", None), (b"WARC-Block-Digest: sha1:AAAA\r\n", b"\r\n\r\n", "block digest differs"), (b"", b"", "a record does not end with two line ends"), (b"WARC-Payload-Digest: sha1:AAAA\r\n", b"\r\n\r\n", "payload digest differs")]
    for head, end, problem in whole:
        found = list(warc.records(io.BytesIO(gzip.compress(record % (head, end)) + good)))
        assert found[0].problem == problem and found[0].payload == b"abc" and len(found) == 5
