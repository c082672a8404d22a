"""WARC archives with a two-level capture index.

Writing: records with equal payloads of at least ``least`` bytes have one
response, the record of the largest page id, and revisits of it.  Each task
appends gzip members to an archive of its own.

Index: the captures (reversed-host URL key, page id, archive, offset, length)
are range-partitioned and sorted; each partition writes its lines as compressed
blocks of ``LINES`` lines and a sparse directory with the first key of every
block.

Reading: a URL's partition is found by bisection of the partitions' first keys
(as many as partitions), its block by bisection of the directory, its line by
bisection in the block that a range read fetched; a further range read fetches
the record, whose payload is held against its digest.

Null html is an empty payload, a null URL has the key "-".  Of records with equal
payload and equal largest page id each is a response.  Records with a null page
id never are the target of revisits unless all equal ones are null; then each is
a response.  Repeated rows are each archived and read back.  An empty table gives
no rows.
A very long payload is one record, read and written whole by one task. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import path_of
from .common import map_arrow, materialize, text_bytes
from .store import PackWriter, RangeReader, place

#: Lines of a compressed index block.
LINES = 512
#: Bytes of neighbouring records of an archive that one task reads back.
SPAN = 1 << 22
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """The sort-friendly key of a URL: reversed host, then path and query."""
    if not url:
        return "-"
    rest = url.partition("://")[2] or url
    m = re.match(r"[^/?#]*", rest)
    host, tail = m[0].lower(), rest[m.end() :].partition("#")[0]
    host = host.rpartition("@")[2]
    name, colon, port = host.partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if colon else "") + ")" + (tail if tail.startswith("/") else "/" + tail)
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", key)


def _uri(url: str) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda c: b"%%%02X" % c[0][0], url.encode())


def _urn(page: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"" if page is None else b"%d" % page)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed: a response, or a revisit if refers_to is given."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _uri(url))
    lines.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if revisit:
        lines += [b"WARC-Refers-To: " + _urn(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse(raw: bytes) -> dict:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and payload (None for revisits) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = rest[: int(fields[b"content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda x: int(x[12:-1]) if x[12:-1] else None
    kind = fields[b"warc-type"].decode()
    digest = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": page(fields[b"warc-record-id"]),
        "record_type": kind,
        "refers_to": page(fields[b"warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes one record for each row; returns the captures (surt, page_id, file, start, length)."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_bytes(html).alias("payload")).withColumn("digest", F.sha1("payload"))
    # written, so that rows with one payload may be split among tasks by the join
    newest = materialize(rows.groupBy("digest").agg(F.max("page_id").alias("newest")), "digests")
    joined = rows.join(newest.hint("shuffle_hash"), "digest").select("page_id", "url", "payload", "newest")

    def write(batches):
        out = PackWriter(f"{folder}/archives", ".warc.gz")
        try:
            for batch in batches:
                rows = []
                for page, address, payload, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    other = last if last is not None and last != page and len(payload) >= least else None
                    raw = record(page, address, payload, base32_sha1(payload), other)
                    rows.append((surt(address), page, out.path, *out.append(gzip.compress(raw, 2, mtime=0))))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["surt", "page_id", "file", "start", "length"])
        finally:
            out.close()

    return materialize(map_arrow(joined, write, "surt string, page_id long, file string, start long, length long"), "captures")


def _line_key(key: str, page: int | None) -> bytes:
    return b"%s %s" % (key.encode(), b"-" if page is None else b"%020d" % (page + (1 << 63)))


def write_index(captures: DataFrame, folder: str, parts: int) -> DataFrame:
    """Writes the compressed blocks and directories; returns (part, first_key, blocks) for each partition that has lines."""
    ordered = captures.repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")

    def write(batches):
        blocks, directory = PackWriter(f"{folder}/index", ".cdx"), PackWriter(f"{folder}/index", ".directory")
        lines: list[bytes] = []
        first, n = None, 0

        def flush():
            nonlocal n
            lines.sort()  # by bytes, as lookups compare
            directory.append(b"%s\t%d\t%d\n" % (lines[0].partition(b"\t")[0], *blocks.append(zlib.compress(b"\n".join(lines), 6))))
            lines.clear()
            n += 1

        try:
            for batch in batches:
                for key, page, file, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    line = _line_key(key, page) + b"\t%s\t%d\t%d" % (file.encode(), start, length)
                    first = first or line.partition(b"\t")[0]
                    if len(lines) >= LINES and lines[-1].partition(b"\t")[0] != line.partition(b"\t")[0]:
                        flush()
                    lines.append(line)
            if lines:
                flush()
        finally:
            blocks.close()
            directory.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([blocks.path.removesuffix(".cdx")]), pa.array([first]), pa.array([n], pa.int64())], names=["part", "first_key", "blocks"])

    return materialize(map_arrow(ordered.select("surt", "page_id", "file", "start", "length"), write, "part string, first_key binary, blocks long"), "cdx")


class Directory:
    """The sparse directory of one index partition and its last block."""

    def __init__(self, part: str, reader: RangeReader):
        self.part, self.reader = part, reader
        system, path = place(part + ".directory")
        with system.open_input_stream(path, compression=None) as f:
            entries = [x.split(b"\t") for x in f.read().split(b"\n")[:-1]]
        self.keys = [x[0] for x in entries]
        self.places = [(int(x[1]), int(x[2])) for x in entries]
        self.block, self.lines = -1, []

    def find(self, key: bytes) -> list[tuple[str, int, int]]:
        """Archive, offset and length of each capture with the key."""
        k = bisect.bisect_right(self.keys, key) - 1
        if k < 0:
            return []
        if k != self.block:
            self.block, self.lines = k, zlib.decompress(self.reader.read(self.part + ".cdx", *self.places[k])).split(b"\n")
        out = []
        for i in range(bisect.bisect_left(self.lines, key + b"\t"), len(self.lines)):
            own, file, start, length = self.lines[i].split(b"\t")
            if own != key:
                break
            out.append((file.decode(), int(start), int(length)))
        return out


def lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(file, start, length) of the captures of distinct (url, page_id) queries."""
    tops = sorted(((bytes(r["first_key"]), r["part"]) for r in index.collect()))  # a row for each index partition

    def route(batches):
        firsts = [k for k, _ in tops]
        for batch in batches:
            keys = [_line_key(surt(u), p) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at = [bisect.bisect_right(firsts, k) - 1 for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([max(i, 0) for i in at], pa.int32()), pa.array(keys, pa.binary())], names=["at", "key"])

    def find(batches):
        reader = RangeReader()
        opened, at_now = None, -1
        for batch in batches:
            rows = []
            for at, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at != at_now and tops:
                    opened, at_now = Directory(tops[at][1], reader), at
                if opened is not None:
                    rows += opened.find(key)
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "start", "length"])
        reader.close()

    routed = map_arrow(queries, route, "at int, key binary").distinct()
    dealt = routed.repartition(max(1, len(tops)), "at").sortWithinPartitions("at", "key")
    return map_arrow(dealt, find, "file string, start long, length long")


def read_records(places: DataFrame, payloads: bool = False) -> DataFrame:
    """The records at (file, start, length), read in the order of the archives."""
    # a stated number of partitions: the places are few bytes, the records that they stand for are not
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.withColumn("span", F.floor(F.col("start") / SPAN)).repartition(parts, "file", "span").sortWithinPartitions("file", "start").drop("span")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def read(batches):
        reader = RangeReader()
        for batch in batches:
            rows = [parse(gzip.decompress(reader.read(*x))) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
        reader.close()

    return map_arrow(ordered.select("file", "start", "length"), read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def archive_and_read(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, parts: int | None = None, payloads: bool = False) -> DataFrame:
    """Writes archives and index, then looks every row up and reads its record back."""
    spark = pages.sparkSession
    folder = path_of(spark, "warc")
    captures = write_archives(pages, folder, key, url, html, least)
    index = write_index(captures, folder, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    queries = pages.select(F.col(url).cast("string").alias("url"), F.col(key).cast("long").alias("page_id"))
    return read_records(lookup(queries, index), payloads)
