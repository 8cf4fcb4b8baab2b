"""WARC archives: a writer of one gzip member per record, and a sequential reader.

Writing: of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the smallest id becomes
a ``response``, the others ``revisit`` records that carry headers only and name it. Each task packs its records into archives,
closes one as soon as its bytes reach ``FILE_BYTES``, and hands it, as one row of raw bytes, to Spark's own text writer, which
ends a file after each row; so any file system that Spark can write will do, and an archive is never larger than
``FILE_BYTES`` and its last record, however long pages lie together. What the writer puts behind a row is an empty gzip member:
every file is a valid multi-member archive.

Reading: each archive is walked once from its start: incremental zlib decompression up to the end of a member,
the record framed by its ``Content-Length``, its block and payload digests verified. One member at a time is held beside the
archive's compressed bytes, which Spark reads as one value: archives of this writer are small, others may have up to 2 GB.

Ids stand in record ids percent-encoded, so that any text can be one; a null id is written as none at all.

Defined results: a null html is an empty payload; rows that repeat the smallest page_id of their payload are all responses; a null page_id is
never referred to (payloads that only have null ids are all responses); other columns are ignored. Line ends in a URI are percent-encoded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplite.llm.common import batches_of, small_batches, table, texts
from hoplite.plans.workspace import Workspace, within

REVISIT_BYTES = 100
#: Compressed bytes at which an archive is closed.
FILE_BYTES = 16 << 20
#: What a null id is written as; ids themselves follow "page:".
NOBODY = "<urn:nobody>"
#: Rows of the table of repeated payloads that are sent to every executor at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Compressed bytes fed to the decompressor at a time.
FEED = 1 << 16
#: A gzip member without content (fixed value).
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
CRLF = b"\r\n"


class CorruptArchive(ValueError):
    """An archive that breaks off, or a record whose framing or digest does not hold."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _named(page: str | None) -> str:
    return NOBODY if page is None else f"<urn:page:{quote(page, safe='', errors='surrogatepass')}>"


def _page(name: str | None) -> str | None:
    """The id that a record id stands for; a foreign one stands for itself."""
    if name is None or name == NOBODY:
        return None
    return unquote(name[10:-1], errors="surrogatepass") if name.startswith("<urn:page:") else name


def record_bytes(kind: str, record_id: str | None, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit holds the HTTP headers only."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + CRLF * 2
    block = http + (payload if kind == "response" else b"")
    digest = lambda x: "sha256:" + hashlib.sha256(x).hexdigest()
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _named(record_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", digest(payload)),
    ]
    if uri is not None:
        head.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        head += [("WARC-Refers-To", _named(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return _member(text.encode("utf-8", "surrogatepass") + block + CRLF * 2)


def members(archive: bytes | pa.Buffer) -> Iterator[bytes]:
    """Decompressed gzip members in their order, fed in small pieces; nothing beyond one member is held."""
    view, at = memoryview(archive), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise CorruptArchive("the last member breaks off")
            piece = view[at : at + FEED]
            try:
                parts.append(z.decompress(piece))
            except zlib.error as e:
                raise CorruptArchive(str(e)) from e
            at += len(piece) - len(z.unused_data)
        if content := b"".join(parts):
            yield content


def parse_record(member: bytes) -> Record:
    head, found, rest = member.partition(CRLF * 2)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise CorruptArchive("no record header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(headers.get("content-length", -1))
    if length < 0 or rest[length:] != CRLF * 2:
        raise CorruptArchive("content length doesn't frame the record")
    return Record(headers, rest[:length])


def read_record(member: bytes) -> tuple[str | None, str | None, int, str, str, str | None]:
    """(id, uri, payload bytes, payload digest, type, id referred to), with the digests verified."""
    r = parse_record(member)
    if "sha256:" + hashlib.sha256(r.block).hexdigest() != r.headers["warc-block-digest"]:
        raise CorruptArchive("block digest")
    http, _, payload = r.block.partition(CRLF * 2)
    claimed = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
    if r.headers["warc-type"] == "response" and (len(payload) != claimed or hashlib.sha256(payload).hexdigest() != digest):
        raise CorruptArchive("payload digest")
    return _page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), claimed, digest, r.headers["warc-type"], _page(r.headers.get("warc-refers-to"))


def _packer(file_bytes: int):
    """Records as archives, one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
        for batch in batches:
            ids, uris, refers = (batch.column(i).to_pylist() for i in range(3))
            for page, uri, first, payload in zip(ids, uris, refers, texts(batch.column(3)), strict=True):
                held.append(record_bytes("response" if first is None else "revisit", page, uri, payload or b"", first))
                size += len(held[-1])
                if size >= file_bytes:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    return pack


_READ = pa.schema([("id", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0):
            yield from batches_of((read_record(m) for m in members(archive.as_buffer())), _READ)  # without a copy of the archive


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as archives below ``path``."""
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    with Workspace(spark, "warc") as work:
        narrow = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
        seen = narrow.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k"))
        repeated = work.put(seen.where("k > 1 and first is not null").select("digest", "first"), "repeated")
        small = F.broadcast(repeated) if within(repeated, BROADCAST_ROWS) else repeated
        rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest")).join(small, "digest", "left")
        refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).cast("string")
        rows = rows.select(F.col("page_id").cast("string").alias("id"), "url", refers.alias("refers"), "html")
        archives = rows.mapInArrow(_packer(file_bytes), "archive binary").select(F.col("archive").cast("string"))
        archives.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``: ``id, uri, payload_bytes, payload_digest, record_type, refers``."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    ddl = "id string, uri string, payload_bytes long, payload_digest string, record_type string, refers string"
    return files.mapInArrow(_read, ddl)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = Workspace(spark, "archives").path("warc")
    write_archives(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    back = read_archives(spark, path)
    return back.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


QUERIES = {"op8_warc": op8_warc}

ORACLES = {
    "op8_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
}
