"""Blocks of documents and exchanges of hashes between them.

A table of blocks holds documents a few megabytes at a time: ids, other columns
and the compressed texts.  A pass over it recomputes hashes from the texts
rather than storing them.  In an exchange every block sends each of its distinct
hashes once, as sorted slices of a bucket each; a task for each bucket compares
the slices of all blocks and answers every slice with a byte for each hash.  A
hash found in very many documents so has an entry for each block only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import BLOCK, blocks, give_back, map_arrow, materialize, text_bytes

#: Bytes of text for which there is a bucket of an exchange: its task holds about twice as much.
SHARE = 1 << 25


def block_table(docs: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """(block, bytes, extra, offsets, z): ``extra`` is an array of structs of the other columns, row by row."""
    limit = limit or BLOCK
    others = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{c}`:{docs.schema[c].dataType.simpleString()}" for c in others)

    def pack(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 20
        press = zstandard.ZstdCompressor(1)
        for batch in batches:
            struct = batch.column(0)
            for lo, hi, data, offsets in blocks(batch.column(1), limit):
                extra = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), struct.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(data)], pa.int64()), extra, pa.array([offsets.tobytes()], pa.binary()), pa.array([press.compress(data.tobytes())], pa.binary())], names=["block", "bytes", "extra", "offsets", "z"])
                number += 1

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("s"), text_bytes(text).alias("b"))
    return materialize(map_arrow(packed, pack, f"block long, bytes long, extra array<struct<{fields}>>, offsets binary, z binary"), "blocks")


def opened(offsets: bytes, z: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a block's texts."""
    at = np.frombuffer(offsets, np.int64)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z, max_output_size=max(1, int(at[-1]))), np.uint8), at


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket numbers that rise with the hashes, so that a sorted array is cut into slices."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def slices(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, end) of each slice that isn't empty, of sorted hashes."""
    b = buckets_of(hashes, n)
    ends = np.append(np.flatnonzero(np.diff(b)) + 1, len(b)) if len(b) else np.zeros(0, np.int64)
    return b[ends - 1] if len(b) else ends, ends


def packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes as planes of the bytes of their differences, compressed: the high planes are nearly empty."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def sent(block: int, hashes: np.ndarray, columns: list[np.ndarray], n: int) -> pa.RecordBatch:
    """Rows (bucket, block, h, v0, v1, ...) of sorted hashes with columns of values."""
    bucket, ends = slices(hashes, n)
    cut = lambda x: [x[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
    arrays = [pa.array(bucket, pa.int64()), pa.array([block] * len(bucket), pa.int64()), pa.array([packed(x) for x in cut(hashes)], pa.binary()), *[pa.array([x.tobytes() for x in cut(c)], pa.binary()) for c in columns]]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "h", *[f"v{i}" for i in range(len(columns))]])


def bucket_count(table: DataFrame) -> int:
    """Buckets of an exchange between the blocks of a table: a number that grows with the texts."""
    total = table.agg(F.sum("bytes")).first()[0] or 0
    return max(2 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))


def exchanged(slices_: DataFrame, kinds: list[str], answer: Callable[..., np.ndarray]) -> DataFrame:
    """(block, answers): for each block the answers to its slices, an array of (bucket, bytes).

    ``answer(blocks, hashes, *columns)`` gets the entries of a bucket and gives a
    uint8 for each; slices whose answers are all 0 aren't answered.
    """

    def compare(table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table.column("h").to_pylist()]
        lengths = np.array([len(p) for p in parts])
        columns = [np.concatenate([np.frombuffer(x, k) for x in table.column(f"v{i}").to_pylist()]) for i, k in enumerate(kinds)]
        owner = np.repeat(np.asarray(table.column("block").combine_chunks(), np.int64), lengths)
        out = answer(owner, np.concatenate(parts), *columns)
        ends = np.cumsum(lengths)
        rows = [(b, out[e - n : e].tobytes()) for b, e, n in zip(table.column("block").to_pylist(), ends.tolist(), lengths.tolist(), strict=True) if out[e - n : e].any()]
        bucket = table.column("bucket")[0].as_py()
        del parts, columns
        give_back()
        return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "a": pa.array([a for _, a in rows], pa.binary())})

    ship(slices_.sparkSession)
    replies = slices_.groupBy("bucket").applyInArrow(compare, "block long, bucket long, a binary")
    return replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "a")).alias("answers"))


def answers_of(hashes: np.ndarray, n: int, answers: list[dict] | None) -> np.ndarray:
    """The answer to each of a block's sorted hashes."""
    out = np.zeros(len(hashes), np.uint8)
    by = {x["bucket"]: x["a"] for x in answers or ()}
    at = 0
    for bucket, end in zip(*(x.tolist() for x in slices(hashes, n)), strict=True):
        if bucket in by:
            out[at:end] = np.frombuffer(by[bucket], np.uint8)
        at = end
    return out
