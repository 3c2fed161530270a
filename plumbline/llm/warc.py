"""WARC archives: one gzip member for each record, written by tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, settle
from .files import Draft, open_stream

#: Bytes read at a time, bytes of pages taken from a batch at a time, and compressed bytes after which a task begins another archive.
CHUNK, AT_ONCE, ARCHIVE = 1 << 18, 4 << 20, 1 << 30
LEVEL = 1
# The format's version line and the profile of a record that repeats a payload.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format or fails a digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str | None) -> str:
    """A record's name: the page's id, escaped, or for a page without one a name that holds none."""
    return f"<urn:uuid:{uuid.uuid4()}>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def page_of(name: str | None) -> str | None:
    """The page's id in a record's name; null if there is none."""
    return unquote(name.removeprefix("<urn:page:").removesuffix(">")) if name and name.startswith("<urn:page:") else None


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, framed by its content length, as a gzip member of its own."""
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{name}: {value}".encode() for name, value in headers]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}".encode(), b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: str | None, url: str | None, payload: bytes, original: str | None) -> bytes:
    """A response, or a revisit of page `original` that keeps the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    headers = [
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if original is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Refers-To", record_id(original)), ("WARC-Profile", REVISIT_PROFILE)]
    return record("revisit", headers, http)


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The contents of each gzip member of a stream, decompressed piece by piece."""
    unpack, parts, rest = None, [], b""
    while rest or (rest := stream.read(chunk)):
        if unpack is None:
            unpack, parts = zlib.decompressobj(31), []
        try:
            parts.append(unpack.decompress(rest))
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        rest = b""
        if unpack.eof:
            yield b"".join(parts)
            rest, unpack = unpack.unused_data, None
    if unpack is not None:
        raise WarcError("the archive ends within a member")


def parse(member: bytes) -> Record:
    """A record by its content length, its block digest verified."""
    head, gap, body = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise WarcError("a record without a version line or the end of its header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"a header line without a colon: {line[:80]!r}")
        headers[name.strip().decode().lower()] = value.strip().decode()
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("a record without a content length") from e
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise WarcError(f"content length {length} doesn't frame the record")
    block = body[:length]
    if (digest := headers.get("warc-block-digest")) and digest != f"sha1:{sha1_base32(block)}":
        raise WarcError(f"the block of {headers.get('warc-record-id')} fails its digest")
    return Record(headers.get("warc-type", ""), headers, block)


def read_pages(stream) -> Iterator[tuple[str | None, int, str, str, str | None]]:
    """Of each record: page id, bytes and digest of the full payload, type, and the page it refers to."""
    for r in map(parse, members(stream)):
        digest = r.headers["warc-payload-digest"].removeprefix("sha1:")
        http, _, payload = r.block.partition(b"\r\n\r\n")
        sizes = [line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(sizes[0])
        if r.kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise WarcError(f"the payload of {r.headers['warc-record-id']} fails its digest")
        name, to = (page_of(r.headers.get(h)) for h in ("warc-record-id", "warc-refers-to"))
        yield name, size, digest, r.kind, to


def write_archives(pages: DataFrame, page_id: str, url: str, html: str, path: str, at_least: int = 0, archive: int = ARCHIVE) -> DataFrame:
    """Write a record for each page below path; return the settled manifest (uri, n_records).

    A task begins another file after `archive` compressed bytes.

    Of pages with equal payloads of at least `at_least` bytes, the one with the smallest id is a
    response and the others revisit it. Only digests and ids are grouped; pages go with their digest's
    first page by a join that Spark may split where a payload is very frequent.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    page = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), body.alias("_body"), F.sha1(body).alias("_sum"))
    first = page.where(F.octet_length("_body") >= at_least).groupBy("_sum").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = first.where("_n > 1").select("_sum", "_first")
    original = F.when((F.col("_id") != F.col("_first")), F.col("_first").cast("string"))
    rows = page.join(again, "_sum", "left").select(F.col("_id").cast("string"), "_url", "_body", original.alias("_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, draft, written, n, uris, counts = TaskContext.get().partitionId(), None, 0, 0, [], []
        for batch in batches:
            step = max(1, AT_ONCE * batch.num_rows // max(1, batch.column(2).nbytes))
            parts = (batch.slice(at, step) for at in range(0, batch.num_rows, step))
            for key, link, payload, to in (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns))):
                if draft is None:
                    uris.append(f"{path}/part-{place:06d}-{uuid.uuid4().hex}.warc.gz")
                    draft, written, n = Draft(uris[-1]), 0, 0
                packed = page_record(key, link, payload, to)
                draft.sink.write(packed)
                written, n = written + len(packed), n + 1
                if written >= archive:
                    draft.publish()
                    counts, draft = [*counts, n], None
        if draft:
            draft.publish()
            counts.append(n)
        yield pa.RecordBatch.from_pydict({"uri": pa.array(uris, pa.string()), "n_records": pa.array(counts, pa.int64())})

    return settle(rows.mapInArrow(run, "uri string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, id_type: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record in the archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                with open_stream(uri) as stream:
                    for row in read_pages(stream):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    spread = manifest.select("uri").repartition(max(1, manifest.count()))
    out = spread.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    number = lambda c: F.col(c).cast(id_type).alias(c)
    return out.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def warc_round_trip(pages: DataFrame, page_id: str, url: str, html: str, path: str | None = None, at_least: int = 0, archive: int = ARCHIVE) -> DataFrame:
    """Write all pages to archives (see write_archives) and read them back (see read_archives).

    A null html is an empty payload, a null url about:blank, a null id comes back as null; pages with
    equal payloads and no smaller id each are a response (repeated rows included). Other columns are
    not read. An empty table gives an empty result.
    """
    manifest = write_archives(pages, page_id, url, html, path or new_path(pages.sparkSession, "warc"), at_least, archive)
    return read_archives(manifest, pages.schema[page_id].dataType.simpleString())


_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '')"
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
