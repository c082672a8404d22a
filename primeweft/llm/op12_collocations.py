"""Collocations from depth-limited count tries.

A *shard* is a few megabytes of text.  Its trie has a node for each phrase of one to
``depth`` words of each language, with its count, and is serialised in preorder: the
phrases sorted, as ranks in the sorted list of the shard's words.  The serialised trie is
cut into ranges of phrases; a task for each range merges the runs of all shards and adds
their counts.  The bounds of the ranges are quantiles of sampled phrases; a range is a
stretch of whole phrases, not of first words, so that the subtrie of a frequent first
word is dealt over many tasks, and a phrase has one node for each shard at most.

Every part of a phrase is as frequent as the phrase.  So nodes under the least count are
dropped after the merge, and joins over the rest give a phrase's parts: its ancestors in
the trie are the left ones, and a link to the node of its last words the right ones.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .common import LOWER, blocks, give_back, map_arrow, materialize, text_bytes

#: Bytes of text of a shard, places of a trie, and bytes of text for which there is a range.
SHARD, PLACES, RANGE = 1 << 23, 1 << 19, 1 << 23
#: Sampled phrases for each range.
SAMPLES = 64
#: Parts in which the best rows of a language are found before they are ranked together.
PARTS = 32

_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAPS = _CUTS.copy()
_GAPS[[9, 32]] = True


# ---------------------------------------------------------------- words of a block
def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, document of each, whether each ends its piece)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_GAPS[data], out=inside[1:-1])
    begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    begins[both] = True
    ends[both] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends)
    of = np.searchsorted(offsets, starts, "right") - 1
    before = np.concatenate([[0], np.cumsum(_CUTS[data])])
    last = np.ones(len(starts), bool)
    last[:-1] = (before[starts[1:]] != before[stops[:-1]]) | (of[1:] != of[:-1])
    at = np.concatenate([[0], np.cumsum(stops - starts)])
    body = data[inside[1:-1]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
    return words, of, last


def _ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order of their bytes, and the rank of each value."""
    coded = values.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[np.asarray(coded.indices)]


def _counted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of the counts of each.

    Codes with counts are runs that are sorted each, which a stable sort merges.
    """
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(codes))) if counts is None else np.add.reduceat(counts, first) if len(first) else first
    return codes[first], sums


def _trie(words: pa.Array, lang: np.ndarray, last: np.ndarray, n: int, depth: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """(words, columns, counts) of the phrases that begin at the first n places.

    The columns are the language and ``depth`` ranks of words from 1, 0 where a phrase is shorter.
    """
    known, rank = _ranked(words)
    base = len(known) + 1
    kinds = int(lang.max()) + 1
    if kinds * base**depth >= 1 << 62:
        raise OverflowError
    ends = np.concatenate([last, np.ones(depth, bool)])
    following = np.concatenate([rank, np.zeros(depth, np.int64)]) + 1
    open_, codes, parts = np.ones(n, bool), lang[:n] * base + following[:n], []
    for d in range(depth):
        if d:
            open_ = open_ & ~ends[d - 1 : d - 1 + n]
            codes = codes * base + np.where(open_, following[d : d + n], 0)
        parts.append(codes[open_] * base ** (depth - 1 - d))
    nodes, counts = _counted(np.concatenate(parts))
    columns = []
    for _ in range(depth):
        columns.append(nodes % base)
        nodes = nodes // base
    return known, [nodes, *columns[::-1]], counts


# ---------------------------------------------------------------- serialised runs
def _squeezed(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1).astype(np.int64)


def _run(langs: list[str], known: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> list:
    """A run of nodes with the words that it needs alone."""
    used = np.unique(np.concatenate(columns[1:]))
    used = used[used > 0]
    own = known.take(pa.array(used - 1))
    lengths = np.asarray(pc.binary_length(own), np.int64)
    _, off, raw = own.buffers()
    at = np.frombuffer(off, np.int64)[own.offset : own.offset + len(own) + 1]
    body = bytes(memoryview(raw)[at[0] : at[-1]]) if raw is not None and len(own) else b""
    local = [np.where(c > 0, np.searchsorted(used, c) + 1, 0) for c in columns[1:]]
    table = [_squeezed(columns[0]), *[_squeezed(c) for c in local], _squeezed(counts), _squeezed(lengths)]
    return [langs, zstandard.ZstdCompressor(1).compress(body), table]


_RUNS = "slot int, langs array<string>, words binary, columns array<binary>"


def _place(bounds: list[tuple], langs: list[str], known: pa.Array, columns: list[np.ndarray]) -> np.ndarray:
    """For each bound the first node that isn't below it."""
    kind = {x: i for i, x in enumerate(langs)}
    order = sorted(langs)
    out = []
    for bound in bounds:
        lo, hi = 0, len(columns[0])
        for level, value in enumerate(bound):
            if level == 0:
                rank = kind.get(value)
                if rank is None:  # languages are numbered in their order
                    lo = hi = int(np.searchsorted(columns[0], np.searchsorted(order, value)))
                    break
            elif value == b"":
                hi = lo
                break
            else:
                a, b = 0, len(known)
                while a < b:
                    m = (a + b) // 2
                    a, b = (m + 1, b) if known[m].as_py() < value else (a, m)
                rank = a + 1
                if a == len(known) or known[a].as_py() != value:
                    lo = hi = lo + int(np.searchsorted(columns[level][lo:hi], rank))
                    break
            run = columns[level][lo:hi]
            lo, hi = lo + int(np.searchsorted(run, rank)), lo + int(np.searchsorted(run, rank, "right"))
        out.append(lo)
    return np.array(out, np.int64)


def _shards(batches, bounds: list[tuple] | None, depth: int, shard: int, places: int, rate: float):
    """Serialised runs of tries for each range; without bounds, sampled phrases."""
    for batch in batches:
        kinds = batch.column(0).to_pylist()
        for lo, hi, data, offsets in blocks(batch.column(1), shard):
            words, of, last = _words(LOWER[data], offsets)
            if not len(words):
                continue
            langs = sorted(set(kinds[lo:hi]))
            number = {x: i for i, x in enumerate(langs)}
            lang = np.array([number[x] for x in kinds[lo:hi]], np.int64)[of]
            if bounds is None:
                rng = np.random.default_rng(len(words))
                for i in np.flatnonzero(rng.random(len(words)) < rate).tolist():
                    end = i + 1
                    while end < min(i + depth, len(words)) and not last[end - 1]:
                        end += 1
                    own = [words[j].as_py() for j in range(i, end)]
                    yield langs[lang[i]], own + [b""] * (depth - len(own))
                continue
            todo = [(a, min(a + places, len(words))) for a in range(0, len(words), places)][::-1]
            while todo:
                a, b = todo.pop()
                end = min(b + depth - 1, len(words))
                try:
                    known, columns, counts = _trie(words.slice(a, end - a), lang[a:end], last[a:end], b - a, depth)
                except OverflowError:
                    todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                    continue
                cuts = [0, *_place(bounds, langs, known, columns).tolist(), len(counts)]
                for slot, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if y > x:
                        yield slot, *_run(langs, known, [c[x:y] for c in columns], counts[x:y])


def _merged(table: pa.Table, depth: int, least: int) -> pa.Table:
    """The counts of a range's nodes from ``least`` on, and the count of all words of each language."""
    langs = sorted({x for row in table.column("langs").to_pylist() for x in row})
    number = {x: i for i, x in enumerate(langs)}
    columns, words, counts, sizes = [[] for _ in range(depth + 1)], [], [], []
    for i in range(table.num_rows):
        parts = [_opened(x) for x in table.column("columns")[i].as_py()]
        at = np.concatenate([[0], np.cumsum(parts[-1])]).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(table.column("words")[i].as_py(), max_output_size=max(1, int(at[-1])))
        words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]))
        sizes.append(len(at) - 1)
        counts.append(parts[-2])
        columns[0].append(np.array([number[x] for x in table.column("langs")[i].as_py()], np.int64)[parts[0]])
        for d in range(depth):
            columns[d + 1].append(parts[d + 1])
    known, rank = _ranked(pa.concat_arrays(words))
    first = np.concatenate([[0], np.cumsum(sizes)])
    for d in range(1, depth + 1):
        columns[d] = [np.concatenate([[0], rank[a:b] + 1])[c] for c, a, b in zip(columns[d], first[:-1], first[1:], strict=True)]
    table_ = [np.concatenate(c) for c in columns]
    count = np.concatenate(counts)
    base = len(known) + 1
    if len(langs) * base**depth < 1 << 62:
        code = functools.reduce(lambda c, x: c * base + x, table_)
    else:  # rows in the order of their columns, numbered
        order = np.lexsort(table_[::-1])
        change = np.zeros(len(order), np.int64)
        for c in table_:
            change[1:] |= c[order[1:]] != c[order[:-1]]
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(change)
    order = np.argsort(code, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
    sums = np.add.reduceat(count[order], begins)
    node = order[begins]
    lang = table_[0][node]
    single = table_[2][node] == 0 if depth > 1 else np.ones(len(node), bool)
    totals = np.bincount(lang[single], sums[single].astype(np.float64), len(langs)) if sums.sum() < 1 << 52 else np.array([sums[single & (lang == i)].sum() for i in range(len(langs))])
    keep = sums >= least
    texts = pa.concat_arrays([known, pa.array([None], pa.large_binary())]).cast(pa.binary())
    some = np.flatnonzero(totals)
    names = pa.array(langs).take(pa.array(np.concatenate([lang[keep], some])))
    arrays = [names]
    for d in range(1, depth + 1):
        ranks = table_[d][node][keep]
        at = np.where(ranks > 0, ranks - 1, len(known))
        arrays.append(texts.take(pa.array(np.concatenate([at, np.full(len(some), len(known))]))))
    arrays.append(pa.array(np.concatenate([sums[keep], totals[some].astype(np.int64)]), pa.int64()))
    give_back()
    return pa.table(arrays, names=["lang", *[f"w{d}" for d in range(1, depth + 1)], "f"])


def count_phrases(docs: DataFrame, least: int, depth: int = 3, shard: int = SHARD, span: int = RANGE, places: int = PLACES) -> DataFrame:
    """(lang, w1, .., f): all phrases of at most ``depth`` words that occur ``least`` times, words as binary.

    Words beyond a phrase are null.  A row whose words are all null has the number of a language's words in a part of the phrases.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_bytes("text").alias("b"))
    total = rows.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // span))
    wanted = min(1.0, ranges * SAMPLES * 256 / max(total, 1))  # so much text has places enough
    rate = min(1.0, 4 * ranges * SAMPLES / max(total * wanted, 1))
    few = rows.where(F.pmod(F.xxhash64("b"), F.lit(1 << 20)) < F.lit(int(wanted * (1 << 20)) + 1)) if wanted < 1 else rows
    named = ", ".join(f"w{d} binary" for d in range(1, depth + 1))

    def sample(batches):
        found = list(_shards(batches, None, depth, shard, places, rate))
        columns = [pa.array([x[0] for x in found], pa.string()), *[pa.array([x[1][d] for x in found], pa.binary()) for d in range(depth)]]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", *[f"w{d}" for d in range(1, depth + 1)]])

    key = ["lang", *[f"w{d}" for d in range(1, depth + 1)]]
    dealt = map_arrow(few, sample, f"lang string, {named}").repartitionByRange(ranges, *key)
    lows = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*key)).alias("low")).select("low.*").collect()
    bounds = sorted((r["lang"], *[bytes(r[k]) for k in key[1:]]) for r in lows)[1:]

    def cut(batches):
        for slot, langs, words, columns in _shards(batches, bounds, depth, shard, places, 0):
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([langs], pa.list_(pa.string())), pa.array([words], pa.binary()), pa.array([columns], pa.list_(pa.binary()))], names=["slot", "langs", "words", "columns"])

    ship(spark)
    runs = map_arrow(rows, cut, _RUNS)
    merged = runs.groupBy("slot").applyInArrow(lambda t: _merged(t, depth, least), f"lang string, {named}, f long")
    return materialize(merged, "phrases")


# ---------------------------------------------------------------- scores
def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(18,0)")
    product = (wide(left) * wide(right)).cast("decimal(38,0)")
    square = (wide(a) * wide(a)).cast("decimal(32,0)")
    return F.call_function("div", (square * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), product)


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, shard: int = SHARD, span: int = RANGE, places: int = PLACES) -> DataFrame:
    """The best phrases of two and three words of each language of (lang, text).

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
    words ``[^\\x20\\x09]+``.  A phrase of at least ``least`` occurrences has for each cut the
    score floor(1,000,000 a a / (l r)), of which the least counts (ties: the earliest cut).
    A phrase of two words inside one of three that has ``share`` percent of its occurrences
    is left out.  The result has ranks up to ``top`` by score, occurrences and phrase.

    A null text is empty, a null language ``und``.  Equal rows count each.  Ties are settled
    by the UTF-8 bytes of the phrases.  A very long text is cut after a number of places,
    with the words that phrases across the cut need.  An empty table, or one without a
    frequent phrase, gives no rows.  Other columns, whatever their names, are left out.
    """
    nodes = count_phrases(docs, least, 3, shard, span, places)
    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    totals = nodes.where(w1.isNull()).groupBy("lang").agg(F.sum("f").alias("n"))
    one = nodes.where(w1.isNotNull() & w2.isNull()).select("lang", "w1", "f")
    two = nodes.where(w2.isNotNull() & w3.isNull()).select("lang", "w1", "w2", "f")
    three = nodes.where(w3.isNotNull()).select("lang", "w1", "w2", "w3", "f")

    def part(df: DataFrame, own: DataFrame, on: dict[str, str], name: str) -> DataFrame:
        """``df`` with the count of the node whose words are columns of it."""
        named = own.select("lang", *[F.col(a).alias(b) for a, b in on.items()], F.col("f").alias(name))
        return df.join(named, ["lang", *on.values()])

    pairs = part(part(two, one, {"w1": "w1"}, "l"), one, {"w1": "w2"}, "r")
    inside = three.select("lang", "w1", "w2", "f").unionAll(three.select("lang", w2.alias("w1"), w3.alias("w2"), "f")).groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer"))
    pairs = pairs.join(inside, ["lang", "w1", "w2"], "left").where(~F.coalesce(100 * F.col("longer") >= share * F.col("f"), F.lit(False)))
    shown = lambda *ws: F.concat_ws(" ", *[F.col(w).cast("string") for w in ws])
    best2 = pairs.select("lang", shown("w1", "w2").alias("phrase"), F.col("f").alias("a"), "l", "r", _score(F.col("f"), F.col("l"), F.col("r")).alias("score"))
    both = part(part(three, one, {"w1": "w1"}, "l1"), two, {"w1": "w2", "w2": "w3"}, "r1")
    both = part(part(both, two, {"w1": "w1", "w2": "w2"}, "l2"), one, {"w1": "w3"}, "r2")
    both = both.select("*", _score(F.col("f"), F.col("l1"), F.col("r1")).alias("s1"), _score(F.col("f"), F.col("l2"), F.col("r2")).alias("s2"))
    first = F.col("s1") <= F.col("s2")
    best3 = both.select("lang", shown("w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = best2.unionAll(best3).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    within = Window.partitionBy("lang", "part").orderBy(*order)
    few = scored.select("*", F.row_number().over(within).alias("at")).where(F.col("at") <= top)
    ranked = few.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint").alias("rank")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
