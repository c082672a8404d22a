"""Exhaustive search of primers with at most k mismatches on both strands.

Every strategy returns the same rows: query (the primer's sequence), contig
columns, strand, start, mismatches, offsets_3p.

* ``arrow``: the production kernel.  It takes contigs of a few million characters
  together, and chunks of longer ones that overlap by the longest primer as a reader
  has cut them.  Of a primer's first and last half one has at most k // 2 mismatches:
  a table of all such variants of the halves, indexed by the two-bit code of a window,
  tells the few places that are compared in full.  Where that table would be too large
  (many mismatches and primers), the k + 1 segments as they are take its place.
* ``seed_join``: the same as an equi-join of windows' halves with all variants of the
  primers' (of k + 1 segments where those are too many), for plans without Python.  The
  variants are sent to the windows where they are few.
* ``expr``: windows times primers; for small fixtures, refused above a size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import mismatch_places, offsets_3p, revcomp, revcomp_text
from ..ship import ship

STRATEGIES = ("arrow", "seed_join", "expr")
#: Characters of a contig that one row holds.
CHUNK = 1 << 20
#: Characters up to which ``expr`` is run.
EXPR_LIMIT = 50_000_000
#: Distinct primers up to which the kernel's table is sent to the executors.
PRIMER_LIMIT = 200_000


def strategy(name: str | None) -> str:
    """The strategy of a name; ``auto`` and none mean the kernel."""
    name = name or "auto"
    if name == "auto":
        return "arrow"
    if name not in STRATEGIES:
        raise ValueError(f"unknown search strategy {name!r}; known: auto, {', '.join(STRATEGIES)}")
    return name


def oriented(queries: DataFrame) -> DataFrame:
    """(query, pattern, strand, length) for both strands of distinct queries; palindromes have both."""
    q = queries.select(F.upper("query").alias("query")).where(F.length("query") > 0).distinct()
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("query").alias("pattern")), F.struct(F.lit("-").alias("strand"), revcomp(F.col("query")).alias("pattern"))))
    return q.select("query", both.alias("o")).select("query", "o.pattern", "o.strand", F.length("query").alias("length"))


def chunks(contigs: DataFrame, overlap: int, size: int, sequence: str = "sequence") -> DataFrame:
    """Rows of at most ``size`` + ``overlap`` characters with ``base``; windows start in the first ``own``.

    Contigs that a reader has cut already (they have base and own) stay as they are.
    """
    if {"base", "own"} <= set(contigs.columns):
        return contigs
    n = F.length(sequence)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cut = contigs.withColumn("base", F.explode(places)).withColumn(sequence, F.expr(f"substring(`{sequence}`, base + 1, {size + overlap})"))
    return cut.withColumn("base", F.col("base").cast("long")).withColumn("own", F.lit(size).cast("long"))


def _segments(length: int, k: int) -> list[tuple[int, int]]:
    """k + 1 segments (start, end) that cover a primer."""
    return [(length * i // (k + 1), length * (i + 1) // (k + 1)) for i in range(k + 1)]


#: Bases of a seed at most: the table of its codes has 4 ** SEED entries.
SEED = 10
#: Places whose codes are made at once, few enough for a core's cache.
STRIDE = 1 << 15
_CODE = np.zeros(256, np.uint32)  # other characters count as A here: more candidates, never fewer
_CODE[list(b"ACGT")] = range(4)
_IS_BASE = np.zeros(256, bool)
_IS_BASE[list(b"ACGT")] = True
#: Entries of the tables of variants; with more, seeds that match exactly are used.
ENTRIES = 1 << 24
#: Variants of seeds that the equi-join sends to the windows.
SENT = 1 << 18


def _codes(code: np.ndarray, n: int) -> np.ndarray:
    """The number of each run of n two-bit codes, by doubling."""
    out, have, done = np.zeros(max(0, len(code) - n + 1), np.uint32), code, 1
    filled = 0
    while True:
        if n >> (done.bit_length() - 1) & 1:
            out = (out << np.uint32(2 * done)) | have[filled : filled + len(out)]
            filled += done
        if 2 * done > n:
            return out
        have = (have[:-done] << np.uint32(2 * done)) | have[done:]
        done *= 2


def variants(seed: np.ndarray, most: int) -> np.ndarray:
    """Numbers of all sequences that differ from a seed (two-bit codes) in at most ``most`` places."""
    n = len(seed)
    own = int(sum(int(c) << 2 * (n - 1 - i) for i, c in enumerate(seed)))
    return own ^ _changes(n, most)


@functools.cache
def _changes(n: int, most: int) -> np.ndarray:
    """What at most ``most`` changed places of n two-bit codes change in a number."""
    flips = np.array([d << 2 * p for p in range(n) for d in (1, 2, 3)], np.int64)
    found = [np.zeros(1, np.int64)]
    for _ in range(most):
        found.append(np.unique(found[-1][:, None] ^ flips))
    return np.unique(np.concatenate(found))


#: Characters of contigs that the kernel takes at once, and candidates that it compares at once.
TAKEN = 1 << 20
COMPARED = 1 << 17
#: Matches of k-mers that are told at a time.
MATCHED = 1 << 18
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def _runs(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    edges = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])) if len(of) else np.zeros(1, np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


class Kernel:
    """Patterns in a matrix for each length, and tables from a seed's code to the patterns it may belong to."""

    def __init__(self, patterns: list[tuple[str, str, str]], k: int):
        self.k = k
        rows = [np.frombuffer(p.encode("ascii", "replace"), np.uint8) for _, p, _ in patterns]
        self.queries = pa.array([q for q, _, _ in patterns], pa.string())
        self.strands = pa.array([s for _, _, s in patterns], pa.string())
        self.minus = np.array([s == "-" for _, _, s in patterns], bool)
        self.length = np.array([len(r) for r in rows], np.int64)
        self.place = np.zeros(len(rows), np.int64)  # of a pattern in the matrix of its length
        self.matrix: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            own = np.flatnonzero(self.length == n)
            self.place[own] = np.arange(len(own))
            self.matrix[n] = np.stack([rows[i] for i in own])
        self.short = [i for i, r in enumerate(rows) if len(r) // 2 < 4 or len(r) <= k]  # too short for seeds
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[tuple[np.ndarray, int, int]]] = {}
        seeded = [i for i in range(len(rows)) if i not in set(self.short)]
        entries = sum(2 * len(_changes(min(len(rows[i]) // 2, SEED), k // 2)) for i in seeded)
        for i in seeded:
            r = rows[i]
            if entries <= ENTRIES:
                n = min(len(r) // 2, SEED)
                for at in (0, len(r) - n):
                    by.setdefault(n, []).append((variants(_CODE[r[at : at + n]], k // 2), i, at))
            else:  # of k + 1 segments one is right
                for at, end in _segments(len(r), k):
                    n = min(end - at, SEED)
                    by.setdefault(n, []).append((variants(_CODE[r[at : at + n]], 0), i, at))
        for n, seeds in by.items():
            code = np.concatenate([v for v, _, _ in seeds])
            pattern = np.concatenate([np.full(len(v), i) for v, i, _ in seeds])
            offset = np.concatenate([np.full(len(v), at) for v, _, at in seeds])
            order = np.argsort(code, kind="stable")
            starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(code, minlength=4**n))))
            self.tables[n] = (starts[1:] > starts[:-1], starts, pattern[order], offset[order])

    def candidates(self, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pattern, start) of places to be compared; some more than once."""
        for i in self.short:
            at = np.arange(max(0, len(text) - int(self.length[i]) + 1))
            yield np.full(len(at), i), at
        code = _CODE[text]
        for n, (wanted, starts, pattern, offset) in self.tables.items():
            for begin in range(0, len(code) - n + 1, STRIDE):
                rolled = _codes(code[begin : begin + STRIDE + n - 1], n)
                at = np.flatnonzero(wanted[rolled])
                found = rolled[at].astype(np.int64)
                lo, count = starts[found], starts[found + 1] - starts[found]
                # places that many patterns ask for, as runs of a base, are taken in parts
                part = (np.cumsum(count) - count) // COMPARED
                for a, b in _runs(part):
                    n_of = count[a:b]
                    entry = np.repeat(lo[a:b] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())
                    yield pattern[entry], np.repeat(at[a:b] + begin, n_of) - offset[entry]

    def hits(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(pattern, contig, start in the text, mismatch flags from the 3' end on) of upper-cased contigs that lie one behind the other."""
        near = [self._near(text, offsets, p, at) for p, at in self.candidates(text)]
        if not near:
            return
        both = np.unique(np.concatenate(near))
        p, at = both // (len(text) + 1), both % (len(text) + 1)
        for n in self.matrix:
            own = np.flatnonzero(self.length[p] == n)
            for a in range(0, len(own), 1 << 16):
                some = own[a : a + (1 << 16)]
                wrong = self._wrong(text, n, p[some], at[some])
                wrong = np.where(self.minus[p[some]][:, None], wrong, wrong[:, ::-1])
                yield p[some], np.searchsorted(offsets, at[some], "right") - 1, at[some], wrong

    def _wrong(self, text: np.ndarray, n: int, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return text[at[:, None] + np.arange(n)] != self.matrix[n][self.place[p]]

    def _near(self, text: np.ndarray, offsets: np.ndarray, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers (pattern, place) of the candidates that lie in a contig with at most k mismatches, so that only those are kept."""
        contig = np.searchsorted(offsets, at, "right") - 1
        ok = (at >= 0) & (at < len(text))
        ok[ok] = at[ok] + self.length[p[ok]] <= offsets[contig[ok] + 1]
        both = np.unique(p[ok] * (len(text) + 1) + at[ok])
        p, at = both // (len(text) + 1), both % (len(text) + 1)
        kept = []
        for n in self.matrix:
            own = np.flatnonzero(self.length[p] == n)
            for a in range(0, len(own), 1 << 16):
                some = own[a : a + (1 << 16)]
                kept.append(both[some[self._wrong(text, n, p[some], at[some]).sum(1) <= self.k]])
        return np.concatenate(kept) if kept else both[:0]


#: The kernel of the last search; a worker serves many tasks of one.
_KEPT: dict[tuple, Kernel] = {}


def _kernel(patterns: list[tuple[str, str, str]], k: int) -> Kernel:
    key = (tuple(patterns), k)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Kernel(patterns, k)
    return _KEPT[key]


def runs_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, upper-cased bytes, offsets) of runs of contigs of about ``TAKEN`` characters; a longer one is a run alone."""
    rows = pc.fill_null(column, "")
    if not pc.all(pc.equal(pc.binary_length(rows), pc.utf8_length(rows))).as_py():
        # other characters count as one base each
        rows = pa.array([x.encode("ascii", "replace").decode() for x in rows.to_pylist()], pa.string())
    rows = rows.cast(pa.large_binary())
    _, places, data = rows.buffers()
    offsets = np.frombuffer(places, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(rows):
        hi = min(max(int(np.searchsorted(offsets, offsets[lo] + TAKEN, "right")) - 1, lo + 1), len(rows))
        yield lo, _UPPER[raw[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class SeedTable:
    """All k-mers of a few texts, both strands, sought in contigs."""

    def __init__(self, texts: list[str], k: int):
        self.k = k
        codes, text_no, minus, q = [], [], [], []
        for number, text in enumerate(texts):
            for turned in (False, True):
                data = np.frombuffer((revcomp_text(text) if turned else text).encode("ascii", "replace"), np.uint8)
                at, own = self._kmers(data)
                codes.append(own)
                q.append(at)
                text_no.append(np.full(len(at), number))
                minus.append(np.full(len(at), turned))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        code = join(codes, np.uint32)
        order = np.argsort(code, kind="stable")
        self.codes = code[order]
        self.text_no, self.minus, self.q = join(text_no, np.int64)[order], join(minus, bool)[order], join(q, np.int64)[order]
        #: by a code's high bits, whether some text may have it
        self.shift = np.uint32(max(0, 2 * k - 22))
        self.wanted = np.zeros(1 << min(22, 2 * k), bool)
        self.wanted[self.codes >> self.shift] = True

    def _kmers(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, code) of each k-mer of bases alone."""
        if len(data) < self.k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        bad = np.concatenate(([0], np.cumsum(~_IS_BASE[data])))
        at = np.flatnonzero(bad[self.k :] == bad[: -self.k])
        return at, _codes(_CODE[data], self.k)[at]

    def matches(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(place in the text, contig, number of the sought text, whether turned, place in it) of each match within a contig.

        About ``MATCHED`` matches at a time, however often the sought texts have a k-mer.
        """
        kept, most = [], 0
        for begin in range(0, max(0, len(text) - self.k + 1), STRIDE):
            piece = text[begin : begin + STRIDE + self.k - 1]
            rolled = _codes(_CODE[piece], self.k)
            at = np.flatnonzero(self.wanted[rolled >> self.shift])
            bad = np.concatenate(([0], np.cumsum(~_IS_BASE[piece])))
            at = at[bad[at + self.k] == bad[at]]
            code = rolled[at]
            at += begin
            lo = np.searchsorted(self.codes, code)
            count = np.searchsorted(self.codes, code, "right") - lo
            contig = np.searchsorted(offsets, at, "right") - 1
            ok = (count > 0) & (at + self.k <= offsets[contig + 1])
            kept.append((at[ok], contig[ok], lo[ok], count[ok]))
            most += int(kept[-1][3].sum())
            if most >= MATCHED:
                yield from self._spread(*map(np.concatenate, zip(*kept, strict=True)))
                kept, most = [], 0
        if most:
            yield from self._spread(*map(np.concatenate, zip(*kept, strict=True)))

    def _spread(self, at: np.ndarray, contig: np.ndarray, lo: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """A match for each of the ``count`` entries from ``lo`` on."""
        upto = np.cumsum(count)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MATCHED, "right")))
            n = count[a:b]
            entry = np.repeat(lo[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.repeat(at[a:b], n), np.repeat(contig[a:b], n), self.text_no[entry], self.minus[entry], self.q[entry]
            a = b


def _arrow(cut: DataFrame, patterns: list[tuple[str, str, str]], k: int, keys: list[str], window: bool) -> DataFrame:
    names = [*keys, "query", "strand", "start", "mismatches", "offsets_3p", *["window"] * window]

    def search(batches):
        kernel = _kernel(patterns, k)
        for batch in batches:
            base, own = (np.asarray(batch.column(len(keys) + j), np.int64) for j in range(2))
            for lo, text, offsets in runs_of(batch.column(len(keys) + 2)):
                for p, contig, at, wrong in kernel.hits(text, offsets):
                    inside = at - offsets[contig]
                    mine = inside < own[lo + contig]
                    p, contig, at, wrong, inside = p[mine], contig[mine], at[mine], wrong[mine], inside[mine]
                    counts = wrong.sum(1)
                    ends = np.concatenate(([0], np.cumsum(counts)))
                    columns = [batch.column(j).take(pa.array(lo + contig)) for j in range(len(keys))]
                    columns += [kernel.queries.take(pa.array(p)), kernel.strands.take(pa.array(p)), pa.array(base[lo + contig] + inside), pa.array(counts, pa.int32())]
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(wrong)[1], pa.int32())))
                    if window:
                        n = wrong.shape[1]
                        seen = np.ascontiguousarray(text[at[:, None] + np.arange(n)])
                        columns.append(pa.StringArray.from_buffers(len(at), pa.py_buffer(np.arange(0, (len(at) + 1) * n, n, dtype=np.int32)), pa.py_buffer(seen)))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in keys) + ", query string, strand string, start long, mismatches int, offsets_3p array<int>" + ", window string" * window
    return cut.select(*keys, "base", "own", "sequence").mapInArrow(search, schema)


def _finish(hits: DataFrame, keys: list[str], window: bool) -> DataFrame:
    places = mismatch_places(F.col("pattern"), F.col("seen"), F.col("length"))
    return hits.withColumn("places", places).select(*keys, "query", "strand", "start", F.size("places").alias("mismatches"), offsets_3p(F.col("places"), F.col("length"), F.col("strand")).alias("offsets_3p"), *[F.col("seen").alias("window")] * window)


def _seeds_of(length: int, k: int, patterns: int) -> tuple[list[tuple[int, int]], int]:
    """Segments (start, end) of primers of a length, and in how many places a window's may differ from one of them."""
    half = length // 2
    if half >= 4 and length > k and 2 * patterns * _count_changes(half, k // 2) <= ENTRIES:
        return [(0, half), (length - half, length)], k // 2
    return _segments(length, k), 0


def _count_changes(n: int, most: int) -> int:
    return sum(math.comb(n, i) * 4**i for i in range(most + 1))


def _changed(seeds: DataFrame, most: int) -> DataFrame:
    """``seeds`` with all sequences that differ from them in at most ``most`` places."""
    for _ in range(most):
        each = F.transform(F.sequence(F.lit(1), F.length("seed")), lambda i: F.transform(F.array(*map(F.lit, "ACGTN")), lambda c: F.concat(F.substring(F.col("seed"), F.lit(1), i - 1), c, F.substring(F.col("seed"), i + 1, F.length("seed")))))
        seeds = seeds.withColumn("seed", F.explode(F.flatten(each))).distinct()
    return seeds


def _seed_join(chunked: DataFrame, orient: DataFrame, k: int, keys: list[str], lengths: list[int], window: bool) -> DataFrame:
    out = None
    counts = {r["length"]: r["count"] for r in orient.groupBy("length").count().collect()}
    # bytes, of which a place is reached at once; in a seed other characters are alike: more candidates, never fewer
    text = F.upper(F.regexp_replace("sequence", r"[^\x00-\x7f]", "?")).cast("binary")
    plain = lambda c: F.regexp_replace(c, "[^ACGT]", "N")
    raw = chunked.select(*keys, "base", "own", text.alias("_raw"), plain(text.cast("string")).cast("binary").alias("_plain"))
    for length in lengths:
        own = orient.where(F.col("length") == length)
        segments, most = _seeds_of(length, k, counts[length])

        def parts(c: Column, before: Column) -> Column:
            return F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), F.substring(c, before + a + 1, F.lit(b - a)).alias("seed")) for i, (a, b) in enumerate(segments)]))  # noqa: B023

        seeds = own.withColumn("p", parts(plain("pattern"), F.lit(0))).select("query", "pattern", "strand", "length", "p.seg", "p.seed")
        seeds = _changed(seeds, most).withColumn("seed", F.col("seed").cast("binary"))
        if len(segments) * counts[length] * _count_changes(length // 2, most) <= SENT:
            seeds = F.broadcast(seeds)  # so that no window is shuffled
        n = F.length("_raw")
        at = F.explode(F.when(n >= length, F.sequence(F.lit(0), F.least(n - length, F.col("own").cast("int") - 1))).otherwise(F.array().cast("array<int>")))
        windows = raw.withColumn("at", at).withColumn("w", parts(F.col("_plain"), F.col("at"))).select(*keys, (F.col("base") + F.col("at")).cast("long").alias("start"), F.substring(F.col("_raw"), F.col("at") + 1, F.lit(length)).alias("seen"), "w.seg", "w.seed")
        candidates = windows.join(seeds, ["seg", "seed"]).drop("seg", "seed").withColumn("seen", F.col("seen").cast("string"))
        near = candidates.where(F.size(mismatch_places(F.col("pattern"), F.col("seen"), F.col("length"))) <= k).distinct()
        out = near if out is None else out.unionByName(near)
    return _finish(out, keys, window)


def _expr(chunked: DataFrame, orient: DataFrame, k: int, keys: list[str], lengths: list[int], window: bool) -> DataFrame:
    out = None
    for length in lengths:
        at = F.explode(F.when(F.length("sequence") >= length, F.sequence(F.lit(0), F.least(F.length("sequence") - length, F.col("own").cast("int") - 1))).otherwise(F.array().cast("array<int>")))
        windows = chunked.withColumn("at", at).select(*keys, (F.col("base") + F.col("at")).cast("long").alias("start"), F.upper(F.substring(F.col("sequence"), F.col("at") + 1, F.lit(length))).alias("seen"))
        near = windows.join(orient.where(F.col("length") == length), F.size(mismatch_places(F.col("pattern"), F.col("seen"), F.col("length"))) <= k)
        out = near if out is None else out.unionByName(near)
    return _finish(out, keys, window)


def search(contigs: DataFrame, queries: DataFrame, k: int = 3, how: str | None = None, sequence: str = "sequence", window: bool = False) -> DataFrame:
    """Sites of distinct ``queries`` (query) in ``contigs`` (any key columns and a sequence).

    ``window``: with the bases of the top strand that the site covers.  Contigs that a
    reader has cut into chunks (they have base and own) are searched chunk by chunk.
    """
    how = strategy(how)
    keys = [c for c in contigs.columns if c not in (sequence, "base", "own")]
    named = contigs.withColumnRenamed(sequence, "sequence")
    orient = oriented(queries)
    table = [(r["query"], r["pattern"], r["strand"]) for r in orient.limit(PRIMER_LIMIT + 1).select("query", "pattern", "strand").collect()]
    if len(table) > PRIMER_LIMIT and how == "arrow":
        how = "seed_join"  # too many primers to send to each task
    if how == "seed_join" or how == "expr":
        lengths = sorted(r["length"] for r in orient.select("length").distinct().collect())
    else:
        lengths = sorted({len(p) for _, p, _ in table})
    if not lengths:
        empty = ", ".join(f"`{c}` {named.schema[c].dataType.simpleString()}" for c in keys) + ", query string, strand string, start long, mismatches int, offsets_3p array<int>" + ", window string" * window
        return contigs.sparkSession.createDataFrame([], empty)
    if how == "arrow":
        ship(contigs.sparkSession)
        # a row is in memory as a whole anyway: the kernel takes it as it is
        whole = named if {"base", "own"} <= set(named.columns) else named.withColumn("base", F.lit(0).cast("long")).withColumn("own", F.coalesce(F.octet_length("sequence"), F.lit(0)).cast("long"))
        return _arrow(whole, table, k, keys, window)
    cut = chunks(named, max(lengths), CHUNK)
    if how == "expr":
        total = named.agg(F.sum(F.length("sequence"))).first()[0] or 0
        if total > EXPR_LIMIT:
            raise ValueError(f"{total} characters are too many for the strategy expr (at most {EXPR_LIMIT})")
    return (_seed_join if how == "seed_join" else _expr)(cut, orient, k, keys, lengths, window)


def naive(sequence: str, primer: str, k: int) -> list[tuple[str, int, int, list[int]]]:
    """(strand, start, mismatches, offsets_3p) by definition, for tests."""
    out = []
    primer, sequence = primer.upper(), sequence.upper()
    for strand, pattern in (("+", primer), ("-", revcomp_text(primer))):
        for i in range(len(sequence) - len(pattern) + 1):
            wrong = [j for j, c in enumerate(pattern) if sequence[i + j] != c]
            if len(wrong) <= k:
                out.append((strand, i, len(wrong), sorted(len(pattern) - 1 - j if strand == "+" else j for j in wrong)))
    return out
