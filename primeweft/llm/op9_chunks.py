"""Media columns as content-defined chunks.

The payload (a text's UTF-8 bytes, padded with zeros to a positive multiple of
64) is stored as 8-bit mono PCM in a WAV file.  The file is cut where a rolling
gear hash has ``BITS`` zero bits, at least ``SHORTEST`` and at most ``LONGEST``
bytes apart.  Tasks append each chunk that is new to them, compressed, to a pack
in the shared space.  A Spark aggregation over the digests picks one place for
each chunk, a join puts it into the ordered chunk lists, and readers follow the
lists with range reads, check every chunk's digest and the file's, and compute
features of the samples.

A task remembers where it has put each chunk, as many as fit its partition's bytes.
Null and empty texts are 64 zero bytes.  Repeated rows give repeated rows, equal
texts equal values.  An empty table gives no rows.
A very long text is cut into chunks by one task. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import path_of
from .common import U64, binary_views, map_arrow, materialize, mix, text_bytes
from .store import PackWriter, RangeReader

SHORTEST, BITS, LONGEST = 256, 10, 8192
UNIT = 64
RATE = 8000
#: Rows whose chunk lists one reader follows in a row.
TOGETHER = 256

_GEAR = (mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)


def wav(payload: bytes) -> bytes:
    """8-bit unsigned mono PCM."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a file that `wav` made."""
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, kind, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[44:]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last 32 bytes at each place, built by doubling the span."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cuts(n: int, candidates: list[int]) -> list[int]:
    """Ends of the chunks of a file of n bytes; candidates: places after which the hash allows a cut."""
    out, at = [], 0
    for c in candidates:
        while c - at > LONGEST:
            at += LONGEST
            out.append(at)
        if c - at >= SHORTEST and c < n:
            at = c
            out.append(at)
    while n - at > LONGEST:
        at += LONGEST
        out.append(at)
    return [*out, n]


def chunk_ends(media: bytes) -> list[int]:
    h = gear(np.frombuffer(media, np.uint8))
    return cuts(len(media), (np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1).tolist())


def feature(payload: bytes) -> str:
    """Integers of the samples: sum, energy about the middle, crossings of the middle, distinct values."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))};values={np.count_nonzero(np.bincount(x + 128))}"


def store(docs: DataFrame, folder: str, key: str, text: str) -> DataFrame:
    """Writes packs; a row for each document: row, key, n_bytes, media_sha256 and the chunks in order."""
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("digest", pa.binary()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])

    def write(batches):
        out = PackWriter(folder, ".pack")
        press = zstandard.ZstdCompressor(3)
        known: dict[bytes, tuple[int, int]] = {}
        n = 0
        try:
            for batch in batches:
                raw, offsets = binary_views(batch.column(1))
                sizes, whole, chunks, lists = [], [], [], [0]
                for d in range(batch.num_rows):
                    media = wav(padded(raw[offsets[d] : offsets[d + 1]].tobytes()))
                    at = 0
                    for end in chunk_ends(media):
                        piece = media[at:end]
                        at = end
                        digest = hashlib.sha256(piece).digest()
                        if digest not in known:
                            known[digest] = out.append(press.compress(piece))
                        chunks.append({"digest": digest, "file": out.path, "start": known[digest][0], "length": known[digest][1]})
                    lists.append(len(chunks))
                    sizes.append(int(offsets[d + 1] - offsets[d]))
                    whole.append(hashlib.sha256(media).hexdigest())
                ids = np.arange(n, n + batch.num_rows, dtype=np.int64) | out.part << 40
                n += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0), pa.array(sizes, pa.int64()), pa.array(whole, pa.string()), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(chunks, item))], names=["row", key, "n_bytes", "media_sha256", "chunks"])
        finally:
            out.close()

    schema = f"row long, `{key}` {kind}, n_bytes long, media_sha256 string, chunks array<struct<digest:binary,file:string,start:long,length:long>>"
    return materialize(map_arrow(docs.select(key, text_bytes(text).alias("b")), write, schema), "chunk-lists")


def deduplicate(rows: DataFrame) -> DataFrame:
    """The ordered chunk lists with one place for each digest: row, chunks."""
    single = rows.select("row", F.posexplode("chunks").alias("ord", "chunk")).select("row", "ord", "chunk.*")
    one = single.groupBy("digest").agg(F.min(F.struct("file", "start", "length")).alias("place"))
    placed = single.select("row", "ord", "digest").join(one, "digest").withColumn("span", F.floor(F.col("row") / TOGETHER))
    return placed.groupBy("span", "row").agg(F.array_sort(F.collect_list(F.struct("ord", "digest", "place"))).alias("chunks"))


def read(lists: DataFrame, rows: DataFrame, key: str, media: bool = False) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    facts = rows.select(F.floor(F.col("row") / TOGETHER).alias("span"), "row", key, "n_bytes", "media_sha256")
    joined = facts.join(lists, ["span", "row"]).select("row", key, "n_bytes", "media_sha256", "chunks.digest", "chunks.place.file", "chunks.place.start", "chunks.place.length")
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * media]

    def rebuild(batches):
        reader, press = RangeReader(), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for _, k, n, sha, digests, files, starts, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = []
                for digest, *at in zip(digests, files, starts, lengths, strict=True):
                    parts.append(press.decompress(reader.read(*at)))
                    if hashlib.sha256(parts[-1]).digest() != digest:
                        raise ValueError("a chunk differs from its digest")
                whole = b"".join(parts)
                if hashlib.sha256(whole).hexdigest() != sha:
                    raise ValueError("a file differs from its digest")
                payload = samples(whole)
                rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(whole), sha, feature(payload), *[whole] * media))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [batch.schema.field(1).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * media]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        reader.close()

    schema = f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media
    return map_arrow(joined, rebuild, schema)


def media_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", media: bool = False) -> DataFrame:
    """Stores every text as chunked media and reads it back."""
    rows = store(docs, path_of(docs.sparkSession, "packs"), key, text)
    return read(deduplicate(rows), rows, key, media)
