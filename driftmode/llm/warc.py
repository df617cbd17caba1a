"""WARC archives with a two-level capture index.

``write_archives`` writes a record for each page, one gzip member each, into a file for each task (more if
a file passes ``ROLL`` bytes). Of pages with equal payloads of at least ``SHARED`` bytes, the one with the
largest id is a response and the others are revisits that refer to it. Duplicates are found on (digest,
length) alone: sizes and the largest id are combined before the shuffle, and the join that hands them
back is one that adaptive execution splits if a payload is very common.

``build_index`` sorts the captures by reversed-host key ("com,example)/path") and page, and writes them as
segments: blocks of ``LINES`` lines, each a zstandard frame, and at the end a sparse directory with the first key and
page of each block. ``CaptureIndex`` finds captures by binary search over segments, then over a directory, and
reads one block by its range; a page of a key with very many captures is found in the same way. ``read_archives`` goes
through the index: records are dealt out to tasks of ``READ`` bytes of archive, ranges of neighbouring records are
fetched in one read, and a revisit's payload is that of the record it refers to, found by its key and page.

Defined results: ids are integers or text; a null payload is empty, a null URL has the empty key; malformed URLs are keys
as they are, lowered; payloads of any length are one record, and one record is in memory at a time; rows with the same
id, payload and URL are records of their own; if all ids of equal payloads are null, all are responses; columns other than
id, URL and payload aren't written; an empty table makes no file and an empty result.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _files, _text
from ._spark import fresh_dir, partitions, written

SHARED = 1000
ROLL = 1 << 30
LINES = 512
#: Bytes that one range read fetches at most when records lie next to each other.
FETCH = 4 << 20
#: Bytes of archives that one task reads, about.
READ = 32 << 20
DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TAIL = "<QQQ4s"
_TAIL_SIZE = struct.calcsize(_TAIL)
_MAGIC = b"CDX2"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query."""
    if not url:
        return ""
    url = one_line(url)
    try:
        u = urlsplit(url)
        host, port = u.hostname, u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    default = port is None or (u.scheme, port) in (("http", 80), ("https", 443))
    return ",".join(reversed(host.split("."))) + ("" if default else f":{port}") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def one_line(url: str) -> str:
    """A URL as a header can hold it."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


Page = int | str | None


def record_id(page: Page) -> str:
    """The name of a page's record; null and the empty text have names of their own."""
    return f"<urn:page:{'' if page is None else page if isinstance(page, int) else "'" + quote(page, safe='')}>"


def page_of(name: str) -> Page:
    tail = name.removeprefix("<urn:page:").removesuffix(">")
    return unquote(tail[1:]) if tail.startswith("'") else int(tail) if tail else None


def place_of(key: str, page: Page) -> tuple:
    """Where a capture stands in the order of the index: null pages come first."""
    return (key, page is not None, page) if page is not None else (key, False, 0)


def make_record(page: Page, url: str | None, payload: bytes, digest: bytes, refers_to: Page, refers_url: str | None, date: str) -> bytes:
    """A WARC/1.1 record. ``refers_to`` makes it a revisit without payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + one_line(url))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Date: {date}"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + one_line(refers_url))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lowered) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


_CAPTURE = "key string, page_id {}, file string, offset bigint, size bigint, kind string"
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]


def _id_type(kind: T.DataType) -> tuple[str, pa.DataType]:
    return ("bigint", pa.int64()) if isinstance(kind, T.IntegralType) else ("string", pa.string())


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, roll: int = ROLL) -> DataFrame:
    """Write the archives; their captures as a table: (key, page_id, file, offset, size, kind)."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    kind, id_type = _id_type(pages.schema[id_col].dataType)
    rows = pages.select(F.col(id_col).cast(kind).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    same = rows.where(F.col("n") >= SHARED).groupBy("digest", "n").agg(F.count("*").alias("c"), F.max(F.struct("id", "url")).alias("to")).where("c > 1").drop("c")
    both = rows.join(same, ["digest", "n"], "left").select("id", "url", "html", F.when(F.col("id").eqNullSafe(F.col("to.id")), None).otherwise(F.col("to.id")).alias("to"), F.col("to.url").alias("to_url"))

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        for batch in batches:
            for part in _text.parts(batch, 2, FETCH):
                found = []
                for row in part.to_pylist():
                    if out is None:
                        uri, at = _files.new_name(folder, "pages", ".warc.gz"), 0
                        out = _files.open_output(uri)
                    payload = row["html"].encode()
                    raw = make_record(row["id"], row["url"], payload, hashlib.sha1(payload, usedforsecurity=False).digest(), row["to"], row["to_url"], date)
                    z = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = z.compress(raw) + z.flush()
                    out.write(member)
                    found.append((url_key(row["url"]), row["id"], uri, at, len(member), "response" if row["to"] is None else "revisit"))
                    at += len(member)
                    if at >= roll:
                        out.close()
                        out = None
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [pa.string(), id_type, pa.string(), pa.int64(), pa.int64(), pa.string()])], _NAMES)
        if out is not None:
            out.close()

    return written(both.mapInArrow(run, _CAPTURE.format(kind)), "captures")


def build_index(captures: DataFrame, folder: str | None = None, *, lines: int = LINES) -> DataFrame:
    """Write the index segments; a row for each: (file, first_key, first_page, last_key, last_page, blocks, captures, bytes)."""
    folder = folder or fresh_dir(captures.sparkSession, "cdx")
    kind, id_type = _id_type(captures.schema["page_id"].dataType)

    @_text.freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        out, held, directory, at, total, stored, first, last = None, [], [], 0, 0, 0, None, None

        def flush() -> None:
            nonlocal at, held
            frame = z.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in held).encode())
            out.write(frame)
            directory.append((*held[0][:2], at, len(frame)))
            at += len(frame)
            held = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    uri = _files.new_name(folder, "segment", ".cdx")
                    out, first = _files.open_output(uri), row[:2]
                held.append(row)
                last = row[:2]
                total += 1
                stored += row[4]
                if len(held) >= lines:
                    flush()
        if out is not None:
            if held:
                flush()
            frame = z.compress(json.dumps(directory).encode())
            out.write(frame + struct.pack(_TAIL, at, len(frame), total, _MAGIC))
            out.close()
            pages = [pa.array([x[1]], id_type) for x in (first, last)]
            yield pa.RecordBatch.from_pydict({"file": [uri], "first_key": [first[0]], "first_page": pages[0], "last_key": [last[0]], "last_page": pages[1], "blocks": [len(directory)], "captures": [total], "bytes": [stored]})

    ordered = captures.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return written(ordered.mapInArrow(run, f"file string, first_key string, first_page {kind}, last_key string, last_page {kind}, blocks bigint, captures bigint, bytes bigint"), "segments")


@functools.lru_cache(maxsize=256)
def _directory(uri: str) -> tuple[list[tuple], list[tuple[int, int]]]:
    """The places of the first captures of a segment's blocks, and the blocks' ranges."""
    end = _files.size_of(uri)
    at, size, _, magic = struct.unpack(_TAIL, _files.read_range(uri, end - _TAIL_SIZE, _TAIL_SIZE))
    if magic != _MAGIC:
        raise ValueError(f"not an index segment: {uri}")
    rows = json.loads(zstandard.ZstdDecompressor().decompress(_files.read_range(uri, at, size)))
    return [place_of(*r[:2]) for r in rows], [(r[2], r[3]) for r in rows]


@functools.lru_cache(maxsize=64)
def _block(uri: str, at: int, size: int) -> list[list]:
    return [json.loads(x) for x in zstandard.ZstdDecompressor().decompress(_files.read_range(uri, at, size)).decode().split("\n")]


@dataclass(frozen=True)
class CaptureIndex:
    """Segments in key order: (first key, last key, file). As many as the tasks that wrote them."""

    segments: tuple[tuple[tuple, tuple, str], ...]

    @classmethod
    def of(cls, segments: DataFrame) -> CaptureIndex:
        rows = segments.select("first_key", "first_page", "last_key", "last_page", "file").collect()
        return cls(tuple(sorted((place_of(*r[:2]), place_of(*r[2:4]), r.file) for r in rows)))

    def _from(self, place: tuple) -> Iterator[list]:
        """The captures from a place on, in order."""
        at = max(0, bisect.bisect_left(self.segments, place, key=lambda s: s[1]))
        for _, _, uri in self.segments[at:]:
            places, ranges = _directory(uri)
            for b in range(max(0, bisect.bisect_left(places, place) - 1), len(places)):
                rows = _block(uri, *ranges[b])
                yield from rows[bisect.bisect_left(rows, place, key=lambda r: place_of(*r[:2])) :]

    def captures(self, url: str | None) -> Iterator[tuple]:
        """All captures of a URL: (key, page_id, file, offset, size, kind)."""
        key = url_key(url)
        for row in self._from((key,)):
            if row[0] != key:
                return
            yield tuple(row)

    def payload(self, url: str | None, page: Page = None) -> bytes | None:
        """The payload of a URL's response (of the page, if one is named)."""
        key = url_key(url)
        for row in self._from((key,) if page is None else place_of(key, page)):
            if row[0] != key or (page is not None and row[1] != page):
                return None
            if row[5] == "response":
                return parse_record(zlib.decompress(_files.read_range(*row[2:5]), 31))[1]
        return None


def read_archives(segments: DataFrame) -> DataFrame:
    """Every record, read by its range: (page_id, url, payload, payload_digest, record_type, refers_to). The payload
    and its hexadecimal SHA-1 are those of the full payload, for revisits as well."""
    index = CaptureIndex.of(segments)
    kind, id_type = _id_type(segments.schema["first_page"].dataType)
    n, stored = segments.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()

    @_text.freed
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for at, size in _directory(uri)[1]:
                    rows = [(r[2], r[3], r[4]) for r in _block(uri, at, size)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.int64()])], ["file", "offset", "size"])

    @_text.freed
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(maxsize=16)
        def referred(url: str | None, page: Page) -> bytes:
            found = index.payload(url, page)
            if found is None:
                raise ValueError(f"page {page} is not in the index")
            return found

        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns)))
            k = 0
            while k < len(places):
                file, start, size = places[k]
                end, last = start + size, k + 1
                while last < len(places) and places[last][0] == file and places[last][1] == end and end + places[last][2] - start <= FETCH:
                    end += places[last][2]
                    last += 1
                data = _files.read_range(file, start, end - start)
                found = []
                for _, offset, n in places[k:last]:
                    headers, payload = parse_record(zlib.decompress(data[offset - start : offset - start + n], 31))
                    to = None
                    if headers["warc-type"] == "revisit":
                        to = page_of(headers["warc-refers-to"])
                        payload = referred(headers.get("warc-refers-to-target-uri"), to)
                    digest = hashlib.sha1(payload, usedforsecurity=False).digest()
                    if headers["warc-payload-digest"] != f"sha1:{base64.b32encode(digest).decode()}":
                        raise ValueError(f"damaged record {headers['warc-record-id']}")
                    found.append((page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), payload, digest.hex(), headers["warc-type"], to))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
                k = last

    kinds = [id_type, pa.string(), pa.binary(), pa.string(), pa.string(), id_type]
    names = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    # (given numbers of partitions aren't coalesced: these rows are small, what they name is not)
    places = segments.select("file").repartition(max(1, n)).mapInArrow(lines, "file string, offset bigint, size bigint")
    tasks = max(partitions(segments.sparkSession), -(-stored // READ))
    places = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(records, f"page_id {kind}, url string, payload binary, payload_digest string, record_type string, refers_to {kind}")
