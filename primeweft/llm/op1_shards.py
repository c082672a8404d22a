"""Sharding by sampled splitters, under the law ``bytes``.

The sort key is (hash of the text, id, row): equal texts are neighbours.

1. A size-weighted sample of keys (an exponential race of ``SAMPLES`` winners for each
   range) gives quantile boundaries of ``FINE`` ranges for each shard, or of more, so
   that a range has ``ROWS`` rows on average at most.
2. An aggregation finds the exact bytes of each range.  Overfull ranges are
   sampled again and subdivided, those of a single text by id, until none is
   over twice the mean.
3. Rows are partitioned by range and sorted in it; bytes before a row, counted
   over ranges and then in its range, give its shard, rows before it its slot.

Shards are near equal in bytes: a group of equal texts goes where its middle
lies and stays whole, unless it is a subdivided one, whose rows go each where
their middle lies.

Null texts count as empty, null ids come first in their group, repeated rows are
told apart by a row number.  An empty table gives no rows.
A very long text is one row whose size alone moves on. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Ranges for each shard and samples for each range.
FINE, SAMPLES = 16, 32
#: Rows of a range on average at most.
ROWS = 1 << 22
#: Times that overfull ranges are subdivided at most; a range of one row can't be.
ROUNDS = 12
_LEAST = -(1 << 63)
Bound = tuple[int, int, int]


def _located(rows: DataFrame, bounds: list[Bound], before: list[tuple[int, int]] | None = None) -> DataFrame:
    """``rows`` with the number of their range, whether their text is subdivided, and bytes and rows before the range."""
    heads = np.array([b[0] for b in bounds], np.int64)
    finer = np.array(sorted({b[0] for b in bounds if b[1:] != (_LEAST, _LEAST)}), np.int64)
    table = None if before is None else np.array(before, np.int64).reshape(-1, 2)
    names = rows.columns

    def locate(batches):
        for batch in batches:
            h, k, r = (np.asarray(batch.column(names.index(c)), np.int64) for c in ("h", "k", "rid"))
            at = np.searchsorted(heads, h, "right")
            split = np.isin(h, finer)
            for i in np.flatnonzero(split).tolist():
                at[i] = bisect.bisect_right(bounds, (int(h[i]), int(k[i]), int(r[i])))
            columns = [*batch.columns, pa.array(at.astype(np.int32)), pa.array(split)]
            if table is not None:
                columns += [pa.array(table[at, 0]), pa.array(table[at, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "range", "split", *["bytes_before", "rows_before"] * (table is not None)])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names) + ", range int, split boolean" + ", bytes_before long, rows_before long" * (table is not None)
    return map_arrow(rows, locate, schema)


def _sample(rows: DataFrame, total: int, n: int, seed: int) -> list[tuple[int, int, int]]:
    """At most n keys, each row drawn in proportion to its size, the same at each evaluation."""
    u = (F.xxhash64(F.lit(seed), "h", "k", "rid").bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    raced = rows.withColumn("race", -F.log(u) / F.col("size")).where(F.col("race") < 1.5 * n / max(total, 1))
    return sorted((r["h"], r["k"], r["rid"]) for r in raced.orderBy("race", "rid").limit(n).select("h", "k", "rid").collect())


def _subdivide(rows: DataFrame, bounds: list[Bound], over: dict[int, tuple[int, bool]], mean: int, seed: int) -> list[Bound]:
    """Further boundaries within the overfull ranges {range: (bytes, of one text)}."""
    total = sum(b for b, _ in over.values())
    n = min(1 << 16, SAMPLES * -(-total // mean))
    by: dict[int, list[Bound]] = {}
    for key in _sample(_located(rows, bounds).where(F.col("range").isin(list(over))), total, n, seed):
        by.setdefault(bisect.bisect_right(bounds, key), []).append(key)
    new: list[Bound] = []
    for number, (size, single) in over.items():
        keys = by.get(number, [])
        parts = -(-size // mean)
        chosen = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
        if single:
            new += chosen
        else:  # a text that was drawn repeatedly gets a range of its own
            heads = [k[0] for k in keys]
            often = {h for h in heads if heads.count(h) * parts > len(keys)} if len(keys) < 4096 else {h for h, m in zip(*np.unique(heads, return_counts=True), strict=True) if m * parts > len(keys)}
            new += [(int(h), _LEAST, _LEAST) for h in {c[0] for c in chosen} | often]
            new += [(int(h) + 1, _LEAST, _LEAST) for h in often if h < (1 << 63) - 1]
    return new


def shard_rows(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"),
        (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("crc"),
        F.xxhash64(raw).alias("h"),
        F.coalesce(F.expr(f"try_cast(`{key}` AS BIGINT)"), F.lit(_LEAST)).alias("k"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = materialize(rows, "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(shards * FINE, -(-count // ROWS))
    mean = max(1, -(-total // ranges))
    drawn = _sample(rows, total, ranges * SAMPLES, 1)
    bounds: list[Bound] = sorted({(drawn[len(drawn) * i // ranges][0], _LEAST, _LEAST) for i in range(1, ranges)}) if drawn else []
    for turn in range(ROUNDS):
        facts = _located(rows, bounds).groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).collect()  # a row for each range
        over = {r["range"]: (r["bytes"], r["a"] == r["b"]) for r in facts if r["bytes"] > 2 * mean and r["n"] > 1}
        more = set(_subdivide(rows, bounds, over, mean, turn + 2)) - set(bounds) if over and turn < ROUNDS - 1 else set()
        if not more:
            break
        bounds = sorted({*bounds, *more})
    before = [(0, 0)] * (len(bounds) + 1)
    by = {r["range"]: r for r in facts}
    b = n = 0
    for i in range(len(before)):
        before[i] = (b, n)
        if i in by:
            b, n = b + by[i]["bytes"], n + by[i]["n"]

    inside = Window.partitionBy("range").orderBy("h", "k", "rid")
    group = Window.partitionBy("range", "h")
    placed = (
        _located(rows, bounds, before)
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("rank", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("twice", F.when(F.col("split"), 2 * F.col("start") + F.col("size")).otherwise(2 * F.min("start").over(group) + F.sum("size").over(group)))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("twice") * shards / (2 * max(total, 1)))).cast("int"))
    )
    placed = materialize(placed.select("id", "size", "crc", "shard", "rank"), "shards")
    first = {r["shard"]: r["r"] for r in placed.groupBy("shard").agg(F.min("rank").alias("r")).collect()}
    starts = F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(shards)])
    return placed.select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.element_at(starts, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the records of a table with unique ids as Parquet, a folder ``shard=N`` for each shard."""
    placed = assigned.select(key, F.col("shard"), F.col("slot"))
    docs.join(placed, key).repartition("shard", F.floor(F.col("slot") / 65536)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
