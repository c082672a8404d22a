"""Shared parts: Arrow batches, words, hashing.

Texts travel as UTF-8 bytes.  A *word* is a run of bytes other than space and
``\\t``..``\\r``, which is what ``bytes.split()`` returns.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from ..ship import ship

U64 = np.uint64
#: Bytes of text handled by numpy at once; a longer document is a block alone.
BLOCK = 1 << 20


# ---------------------------------------------------------------- Spark
def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a written table of the shared scratch space, which cuts its lineage."""
    return written(df, tag)[0]


def give_back() -> None:
    """Returns what a task freed to the system: Python workers live on and serve other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def texts(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def text_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df`` dealt over all cores where its files make too few partitions."""
    spark = df.sparkSession
    least = least or spark.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


# ---------------------------------------------------------------- Arrow batches
def binary_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    limit = limit or BLOCK
    raw, offsets = binary_views(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# ---------------------------------------------------------------- words and hashes
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of each document; document d has words first[d] to first[d + 1]."""
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    begins = inside[1:] & ~inside[:-1]
    finish = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    begins[both] = True
    finish[both] = True
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finish)
    return starts, ends, np.searchsorted(starts, offsets)


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_ODD, _TURNED = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)
#: Masks of the first bytes of a gram of 8, and bytes of a span up to which grams are mixed.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
LONG = 64


def mixed(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of pairs of integers: two terms that each mix one with the mixed other."""
    base = U64(BASES[seed])
    return mix((mix(x + base) ^ y) * _ODD) + mix((mix(y ^ base) + x) * _TURNED)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of ``data``.

    A span of up to 8 bytes is one gram, of which the hash is a bijection for each length;
    a longer one is mixed gram by gram, and one of over ``LONG`` bytes hashed as a whole.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    if not len(starts):
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    grams = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    size = ends - starts
    out = mix((grams[starts] & _MASKS[np.minimum(size, 8)]) ^ U64(BASES[seed])) + size.astype(U64) * _ODD
    far = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(far):
        gram = grams[starts[far] + at] & _MASKS[np.minimum(size[far] - at, 8)]
        out[far] = mixed(out[far], gram, seed)
        at += 8
        far = far[size[far] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([seed]))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k values, from those of runs of half the length; the last k - 1 places have none."""
    if len(words) < k:
        return np.zeros(0, U64)
    have, span, out, filled = words, 1, None, 0
    while True:
        if k & span:
            out = have if out is None else mixed(out[: len(have) - filled], have[filled:], seed)
            filled += span
        if 2 * span > k:
            return mix(out + U64(k))
        have = mixed(have[:-span], have[span:], seed)
        span *= 2


def same_spans(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``a`` from ``at`` on are those of ``b`` from ``bt`` on, for each span."""

    def grams(data: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))

    x, y = grams(a), grams(b)
    same = (x[at] ^ y[bt]) & _MASKS[np.minimum(size, 8)] == 0
    far, step = np.flatnonzero(same & (size > 8) & (size <= LONG)), 8
    while len(far):
        same[far] = (x[at[far] + step] ^ y[bt[far] + step]) & _MASKS[np.minimum(size[far] - step, 8)] == 0
        step += 8
        far = far[same[far] & (size[far] > step)]
    for i in np.flatnonzero(same & (size > LONG)).tolist():
        same[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[bt[i] : bt[i] + size[i]])
    return same


def window_places(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n - k + 1 windows over all words: whether it lies in one document."""
    ok = np.ones(max(0, n - k + 1), bool)
    for back in range(1, k):
        cut = first[1:-1] - back
        cut = cut[(cut >= 0) & (cut < len(ok))]
        ok[cut] = False
    return ok


def doc_of(first: np.ndarray) -> np.ndarray:
    """For each word, its document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
