"""WARC archives: pages go in as response or revisit records, one gzip member each, and are read back as a stream."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import flat_text, materialize, shared_dir, text_slices

#: Bytes taken from a file at a time, and bytes decompressed at a time.
CHUNK, PIECE = 1 << 20, 1 << 18
#: A record's header, or the HTTP header in its block, is at most this long.
HEADER_BYTES = 1 << 20
BROADCAST_BYTES = 32 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, offset long, record_type string, record_id string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"


class Damaged(ValueError):
    """The archive cannot be read on from here."""


def digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def header_value(text: str | None) -> str | None:
    """A URI for a header line: control characters and blanks are percent-encoded, so that no value can end its line."""
    return text if text is None else "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in text)


# --- writing ----------------------------------------------------------------------------------------------------------


def _head(fields: list[tuple[str, str | None]], version: str = "WARC/1.1") -> bytes:
    return "\r\n".join([version, *(f"{k}: {v}" for k, v in fields if v is not None)]).encode() + END


def _member(out, parts: list, level: int) -> int:
    """Write `parts` as one gzip member, a piece at a time; returns its size."""
    z, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    for part in parts:
        for lo in range(0, len(part), CHUNK):
            done = z.compress(part[lo : lo + CHUNK])
            if done:
                out.write(done)
                size += len(done)
    done = z.flush()
    out.write(done)
    return size + len(done)


def _page_record(page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None, refers_uri: str | None, date: str) -> list:
    claimed = f"sha1:{digest(hashlib.sha1(payload))}"
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = [http] if refers_to is not None else [http, payload]
    whole = hashlib.sha1()
    for part in block:
        whole.update(part)
    revisit = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Refers-To-Target-URI", header_value(refers_uri))]
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", header_value(url)),
        *(revisit if refers_to is not None else []),
        ("WARC-Payload-Digest", claimed),
        ("WARC-Block-Digest", f"sha1:{digest(whole)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(sum(len(p) for p in block))),
    ]
    return [_head(fields), *block, END]


def marked_copies(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, refers_uri): which page each one repeats. Of pages with equal html of at least
    `min_revisit_bytes` bytes, the one with the largest page_id is repeated by the others; refers_to is null for it, for
    pages without copies, for shorter ones and where all of the copies' ids are null. Rows that share the largest id all
    count as that page. Null html is empty html.

    Html is compared by its sha256; only digests and ids are grouped, and html moves only where pages with copies are
    too many to be sent to every task (measured)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    key = F.when(F.octet_length("html") >= min_revisit_bytes, F.sha2("html", 256))
    keyed = rows.select("page_id", "url", key.alias("key")).where("key is not null")
    top = F.max(F.struct("page_id", "url")).alias("top")
    copies = keyed.groupBy("key").agg(top, F.count("*").alias("n")).where("n > 1 and top.page_id is not null")
    copies = materialize(copies.select("key", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_uri")), "warc-copies")
    size = copies.agg(F.coalesce(F.sum(F.lit(128) + F.coalesce(F.octet_length("refers_uri"), F.lit(0))), F.lit(0))).first()[0]
    joined = rows.withColumn("key", key).join(F.broadcast(copies) if size <= BROADCAST_BYTES else copies.hint("merge"), "key", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("refers_to")).alias("refers_to"), F.when(other, F.col("refers_uri")).alias("refers_uri"))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, archive_bytes: int = 64 << 20, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(file, records, bytes) of the archives that hold `pages` (page_id, url, html), written under `folder`, a URI that the
    executors reach (file, hdfs, s3, gs). See `marked_copies` for which pages become revisits; the rest are responses.

    Each task writes archives of about `archive_bytes`, one gzip member a record, the first a warcinfo record, under names
    of their own: what a lost or repeated attempt leaves is in no row of the result and never read. No page: no archive.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done, out = [], None

        def close():
            out.close()
            done.append((file, records, size))

        for batch in text_slices(batches, column="html"):
            data, at = flat_text(batch.column("html"))
            data = memoryview(data)
            told = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "refers_uri"))
            for row, (page_id, url, refers_to, refers_uri) in enumerate(zip(*told)):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    file, records, size = f"{folder.rstrip('/')}/{name}", 0, 0
                    out = fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                    about = b"software: vectide\r\nformat: WARC File Format 1.1\r\n"
                    size += _member(out, [_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(about)))]), about, END], level)
                size += _member(out, _page_record(page_id, url, data[at[row] : at[row + 1]], refers_to, refers_uri, date), level)
                records += 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return materialize(marked_copies(pages, min_revisit_bytes).mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


# --- reading ----------------------------------------------------------------------------------------------------------


class Record(NamedTuple):
    offset: int
    fields: dict[str, str]
    payload_digest: str
    payload_bytes: int
    payload: bytes | None
    problem: str | None


class _Member:
    """One gzip member of a stream, decompressed a piece at a time."""

    def __init__(self, stream, ahead: bytes):
        self.stream, self.raw, self.z = stream, ahead, zlib.decompressobj(31)
        self.taken = len(ahead)

    def more(self) -> bytes:
        """The next piece; empty at the member's end."""
        while not self.z.eof:
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                self.taken += len(self.raw)
            ended = not self.raw
            try:
                out = self.z.decompress(self.raw, PIECE)
            except zlib.error as e:
                raise Damaged(str(e)) from None
            self.raw = self.z.unconsumed_tail
            if out:
                return out
            if ended and not self.z.eof:
                raise Damaged("the archive ends within a record")
        return b""

    def until_blank_line(self, ahead: bytes, most: int) -> tuple[bytes, bytes]:
        """What comes before the first blank line, and what has been read beyond it."""
        at = ahead.find(END)
        while at < 0:
            if len(ahead) > most:
                raise Damaged("a header has no end")
            piece = self.more()
            if not piece:
                raise Damaged("a record ends within its header")
            start = max(0, len(ahead) - 3)
            ahead += piece
            at = ahead.find(END, start)
        return ahead[:at], ahead[at + 4 :]


def _fields(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def _one(member: _Member, offset: int, keep_payload: bool) -> Record:
    head, rest = member.until_blank_line(b"", HEADER_BYTES)
    if not head.startswith(b"WARC/"):
        raise Damaged("not a WARC record")
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    left, block, payload, kept, size = int(length), hashlib.sha1(), hashlib.sha1(), [], 0
    http = b"" if fields.get("content-type", "").replace(" ", "").startswith("application/http") else None
    stated = None
    while left > 0:
        piece = rest or member.more()
        if not piece:
            raise Damaged("a record is shorter than its content length")
        piece, rest = piece[:left], piece[left:]
        left -= len(piece)
        block.update(piece)
        if http is not None and stated is None:  # still in the HTTP header
            http += piece
            at = http.find(END)
            if at < 0:
                if len(http) > HEADER_BYTES:
                    raise Damaged("a header has no end")
                continue
            stated, piece, http = _fields(http[:at]), http[at + 4 :], b""
        payload.update(piece)
        size += len(piece)
        if keep_payload:
            kept.append(piece)
    while len(rest) <= 4 and (piece := member.more()):
        rest += piece
    problem = None
    if rest != END:
        problem = "a record does not end with two line ends"
    claimed = fields.get("warc-block-digest")
    if claimed and claimed != f"sha1:{digest(block)}":
        problem = "block digest differs"
    claimed = fields.get("warc-payload-digest")
    if fields.get("warc-type") == "revisit":  # holds the header only: size and digest are what it says of the page it repeats
        told = (stated or {}).get("content-length", "")
        size = int(told) if told.isascii() and told.isdigit() else None
        return Record(offset, fields, (claimed or "").removeprefix("sha1:"), size, None, problem)
    if claimed and claimed != f"sha1:{digest(payload)}":
        problem = "payload digest differs"
    return Record(offset, fields, digest(payload), size, b"".join(kept) if keep_payload else None, problem)


def records(stream, keep_payload: bool = True) -> Iterator[Record]:
    """The records of an open archive, in order. Memory is one piece, and one payload if payloads are kept. A record whose
    digests or end are not as stated has a `problem`; where the archive itself is damaged, the last record has no
    fields and says why."""
    offset, ahead = 0, b""
    while True:
        ahead = ahead or stream.read(CHUNK)
        if not ahead:
            return
        member = _Member(stream, ahead)
        try:
            yield _one(member, offset, keep_payload)
            while member.more():  # nothing, unless the record has too long an end
                pass
        except Damaged as e:
            yield Record(offset, {}, "", 0, None, str(e))
            return
        ahead = member.z.unused_data
        offset += member.taken - len(ahead)


def read_archives(files: DataFrame, keep_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record of the archives in column `file` of `files` (URIs), warcinfo records included: file, offset
    of its gzip member, record_type, record_id, uri, date, refers_to, payload_digest (base32 SHA-1, of what was read; for
    revisits as stated), payload_bytes, payload (null for revisits, or if payloads are not kept) and problem (null if
    digests and framing hold; a damaged archive ends in one row with nothing but its place and the problem).

    An archive is read by one task, from front to end, so archives should be many and of moderate size. No file: no row."""
    n = files.count()

    def read(batches):
        def told(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()])], [c.split()[0] for c in RECORD.split(", ")])

        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = pafs.FileSystem.from_uri(file)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for r in records(stream, keep_payload):
                        get = r.fields.get
                        size = r.payload_bytes if r.fields else None
                        rows.append((file, r.offset, get("warc-type"), get("warc-record-id"), get("warc-target-uri"), get("warc-date"), get("warc-refers-to"), r.payload_digest if r.fields else None, size, r.payload, r.problem))
                        held += 500 + len(r.payload or b"")
                        if held >= batch_bytes:
                            yield told(rows)
                            rows, held = [], 0
                if rows:
                    yield told(rows)

    return files.select("file").repartition(max(1, min(n, 20_000))).mapInArrow(read, RECORD)


def archived_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, verified) of all pages, as read back from
    archives that are written to `folder` (default: a new one in the shared folder) when this is called. Nulls, copies and
    repeated ids: see `marked_copies`; a null page_id stays null. Control characters and blanks of urls are percent-encoded."""
    manifest = write_archives(pages, folder or f"{shared_dir(spark)}/vectide/warc-{uuid.uuid4().hex}", min_revisit_bytes)
    found = read_archives(manifest, keep_payload=False).where("record_type in ('response', 'revisit') or problem is not null")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.col("uri").alias("url"), F.col("problem").isNull().alias("verified")
    )


_HEX = "list_sum([(strpos('0123456789abcdef', hex[g * 5 + j]) - 1) * (1 << (4 * (5 - j))) FOR j IN [1, 2, 3, 4, 5]])"
ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p),
e AS (SELECT *, [CAST({_HEX} AS INTEGER) FOR g IN [0, 1, 2, 3, 4, 5, 6, 7]] AS parts FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> s) & 31 AS INTEGER) + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR n IN parts], '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to, url, TRUE AS verified
FROM e
"""
