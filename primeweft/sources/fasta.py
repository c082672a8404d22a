"""FASTA files, plain and blocked gzip, read by many tasks each.

Plain files are split by Spark's text reader, blocked gzip files by `BlockedGzip`, a
data source whose partitions are ranges of members.  Each split is cut into chunks of
bases in places of its own (contigs counted from the split's start).  A table with a
row for each split then tells, by running sums, where each split lies in its file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..scratch import written
from ..ship import ship

#: Bases of a chunk's own, compressed bytes of a range of members, bytes read at once.
CHUNK, RANGE, READ = 1 << 20, 1 << 24, 1 << 22
#: Tasks of blocked files for each core, where ranges are many.
TASKS = 4
_MAGIC = b"\x1f\x8b\x08\x04"


# ---------------------------------------------------------------- blocked gzip
def member_size(data: bytes, at: int = 0) -> int | None:
    """The size of the blocked gzip member whose header begins at ``at``; None if none does or its header is cut."""
    if data[at : at + 4] != _MAGIC or at + 12 > len(data):
        return None
    extra = int.from_bytes(data[at + 10 : at + 12], "little")
    i, end = at + 12, at + 12 + extra
    while i + 4 <= end <= len(data):
        n = int.from_bytes(data[i + 2 : i + 4], "little")
        if data[i : i + 2] == b"BC" and n == 2:
            return int.from_bytes(data[i + 4 : i + 6], "little") + 1
        i += 4 + n
    return None


def bgzf_members(data: bytes) -> list[tuple[int, int]]:
    """(offset, size) of each block of a blocked gzip file; a plain gzip file or a cut one raises."""
    out, at = [], 0
    while at < len(data):
        size = member_size(data, at)
        if size is None:
            raise ValueError(f"no blocked gzip member at {at}")
        if at + size > len(data):
            raise ValueError(f"the member at {at} is cut")
        out.append((at, size))
        at += size
    return out


def inflate_member(member: bytes) -> bytes:
    """A block's contents, held against its stated length and sum."""
    extra = int.from_bytes(member[10:12], "little")
    raw = zlib.decompress(member[12 + extra : -8], wbits=-15)
    if len(raw) != int.from_bytes(member[-4:], "little") or zlib.crc32(raw) != int.from_bytes(member[-8:-4], "little"):
        raise ValueError("a member's contents differ from its length or sum")
    return raw


def _opened(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system.open_input_file(path)


class Range:
    def __init__(self, uri: str, begin: int, end: int):
        self.uri, self.begin, self.end = uri, begin, end


class Ranges(InputPartition):
    """Ranges that follow each other, of one file or of several, for one task."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


class BlockedGzip(DataSource):
    """(file, block, value): the lines of blocked gzip files; ``block`` is where the range that a line begins in begins.

    A task reads ranges of up to ``task`` bytes, ``range`` where it isn't given.
    """

    @classmethod
    def name(cls) -> str:
        return "primeweft_bgzf"

    def schema(self) -> str:
        return "file string, block long, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.uris = options["uris"].split("\n")
        self.range = int(options.get("range", RANGE))
        self.task = int(options.get("task", self.range))

    def partitions(self) -> list[Ranges]:
        out, own, held = [], [], 0
        for uri in self.uris:
            with _opened(uri) as f:
                size = f.size()
            for a in range(0, size, self.range):
                b = min(a + self.range, size)
                if own and held + b - a > self.task:
                    out.append(Ranges(own))
                    own, held = [], 0
                own.append(Range(uri, a, b))
                held += b - a
        return [*out, Ranges(own)] if own else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from self._read(r)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        # a line belongs to the range that holds the byte before it; the first range has the first line
        rest, begun = b"", partition.begin == 0
        with _opened(partition.uri) as f:
            for member_at, text in _texts(f, partition.begin, partition.end):
                if member_at >= partition.end:
                    line, found, _ = text.partition(b"\n")
                    rest += line
                    if begun and found or not begun:
                        break
                    continue
                if not begun:
                    _, found, text = text.partition(b"\n")
                    if not found:
                        continue
                    begun = True
                whole, found, tail = text.rpartition(b"\n")
                if not found:
                    rest += tail
                    continue
                yield self._batch(partition, (rest + whole).split(b"\n"))
                rest = tail
        if begun and rest:
            yield self._batch(partition, [rest])

    def _batch(self, partition: Range, lines: list[bytes]) -> pa.RecordBatch:
        n = len(lines)
        values = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([partition.uri] * n), pa.array([partition.begin] * n, pa.int64()), values], names=["file", "block", "value"])


def _texts(f, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of the members from the first one at or after ``begin`` on; reads go little beyond ``end`` at a time."""
    size = f.size()
    at = begin
    if begin:
        data = f.read_at(min(1 << 18, size - begin), begin)
        i = data.find(_MAGIC)
        while i >= 0:
            n = member_size(data, i)
            if n is not None and (begin + i + n == size or member_size(data, i + n) is not None):
                break
            i = data.find(_MAGIC, i + 1)
        if i < 0:
            if size - begin > 1 << 17:
                raise ValueError(f"no blocked gzip member behind {begin}")
            return
        at = begin + i
    data, base = b"", at
    while at < size:
        if base + len(data) - at < 1 << 17 and base + len(data) < size:
            data, base = f.read_at(min(READ, max(end - at, 0) + (1 << 17), size - at), at), at
        n = member_size(data, at - base)
        if n is None or at + n > size:
            raise ValueError(f"the member at {at} is cut or not blocked gzip")
        yield at, inflate_member(data[at - base : at - base + n])
        at += n


def is_blocked(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as blocked gzip does; a plain gzip file raises, since it can't be split."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hadoop)
    try:
        head = bytes(b for b in (stream.read() for _ in range(64)) if b >= 0)
    finally:
        stream.close()
    if head[:2] == b"\x1f\x8b" and member_size(head) is None:
        raise ValueError(f"{path} is plain gzip; blocked gzip is needed")
    return head[:2] == b"\x1f\x8b"


def qualified(spark: SparkSession, path: str) -> str:
    """The whole URI of a path, as Spark names its files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toUri().toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)


def _lines(spark: SparkSession, paths: list[str], size: int) -> DataFrame:
    """(file, block, value): lines with their file and where their split begins."""
    blocked = [p for p in paths if is_blocked(spark, p)]
    reachable = [p for p in blocked if qualified(spark, p).partition(":")[0] in ("file", "s3", "s3a", "gs", "hdfs")]
    parts = []
    if plain := [p for p in paths if p not in reachable]:  # the text reader inflates a blocked file by one task
        parts.append(spark.read.text(plain).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value"))
    if reachable:
        spark.dataSource.register(BlockedGzip)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        total = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(hadoop, reachable))
        # small ranges are read together, in several tasks for each core, so that starting them doesn't outweigh reading
        task = max(size, min(RANGE, total // (TASKS * spark.sparkContext.defaultParallelism)))
        parts.append(spark.read.format("primeweft_bgzf").option("uris", "\n".join(qualified(spark, p) for p in reachable)).option("range", size).option("task", task).load())
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- chunks
class _Cutter:
    """Cuts the lines of one split into chunks, in places counted from the split's start."""

    def __init__(self, file: str, block: int, size: int, overlap: int):
        self.file, self.block, self.size, self.overlap = file, block, size, overlap
        self.idx, self.name, self.base = 0, None, 0
        self.held: list[str] = []
        self.n = 0

    def row(self, text: str, own: int, open_: bool) -> tuple:
        return (self.file, self.block, self.idx, self.name, self.base, own, open_, text)

    def bases(self, text: str) -> Iterator[tuple]:
        self.held.append(text)
        self.n += len(text)
        if self.n >= self.size + max(self.overlap, 1):
            text, at = "".join(self.held), 0
            while len(text) - at >= self.size + max(self.overlap, 1):
                yield self.row(text[at : at + self.size + self.overlap], self.size, False)
                at += self.size
                self.base += self.size
            self.held, self.n = [text[at:]], len(text) - at

    def close(self, open_: bool) -> Iterator[tuple]:
        text = "".join(self.held)
        if text or (self.name is not None and not self.base):
            yield self.row(text, len(text), open_)

    def header(self, line: str) -> Iterator[tuple]:
        yield from self.close(False)
        self.idx, self.name, self.base, self.held, self.n = self.idx + 1, (line[1:].split() or [""])[0], 0, [], 0


def _cut(size: int, overlap: int):
    names = ["file", "block", "idx", "name", "base", "own", "open", "sequence"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], names=names)

    def cut(batches) -> Iterator[pa.RecordBatch]:
        cutter = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block, value = batch.columns
            value = value.fill_null("")
            head = pc.starts_with(value, ">")
            heads = set(pc.indices_nonzero(head).to_pylist())
            changed = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
            splits = {0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist())}
            cuts = sorted(heads | splits | {batch.num_rows})
            rows: list[tuple] = []
            for a, b in zip([0, *cuts], cuts, strict=False):
                if a == b:
                    continue
                own = (file[a].as_py(), block[a].as_py())
                if a in splits and (cutter is None or own != (cutter.file, cutter.block)):
                    if cutter is not None:
                        rows += cutter.close(True)
                    cutter = _Cutter(*own, size, overlap)
                lines = value.slice(a, b - a).to_pylist()
                if a in heads:
                    rows += cutter.header(lines.pop(0))
                if lines and (text := "".join("".join(lines).split())):
                    rows += cutter.bases(text)
            yield batch_of(rows)
        if cutter is not None:
            yield batch_of(list(cutter.close(True)))

    return cut


def read_fasta(spark: SparkSession, paths: str | list[str], chunk: int = CHUNK, overlap: int = 0, range_: int = RANGE) -> DataFrame:
    """(file, contig_idx, chrom, base, own, sequence): the contigs' bases in chunks.

    A contig of any length is never one row.  A chunk goes on for ``overlap`` bases
    behind its ``own`` ones, so that a search of windows of up to ``overlap`` bases that
    start in the own ones loses and doubles nothing.  A contig without bases is one
    empty chunk.  All files are read by one plan, and each is parsed once: the chunks
    are written to the scratch space, to which a table of the splits (a row for each
    split of a file, tens of megabytes) adds their places.  Cut and plain gzip files and bases
    before the first header raise.
    """
    ship(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = "file string, block long, idx int, name string, base long, own long, open boolean, sequence string"
    local, _ = written(_lines(spark, paths, range_).mapInArrow(_cut(chunk, overlap), schema), "fasta")
    each = local.groupBy("file", "block").agg(
        F.max("idx").alias("headers"),
        F.max_by("name", "idx").alias("last_name"),
        F.sum(F.when(F.col("idx") == 0, F.col("own")).otherwise(0)).alias("lead"),
        F.max(F.when((F.col("idx") == 0) & (F.col("base") == 0), F.substring("sequence", 1, max(1, overlap)))).alias("head"),
        F.max_by(F.col("base") + F.col("own"), F.struct("idx", "base")).alias("tail"),
    )
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    runs = each.withColumn("run", F.sum((F.col("headers") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("so_far", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    short = (F.lead("headers").over(order) == 0) & F.lead("block", 2).over(order).isNotNull() & (F.lead("lead").over(order) < overlap)
    placed = runs.select(
        "file",
        "block",
        (F.coalesce(F.sum("headers").over(before), F.lit(0)) - 1).cast("int").alias("first"),
        F.last("last_name", ignorenulls=True).over(before).alias("current"),
        F.coalesce(F.lag("so_far").over(order), F.lit(0)).alias("offset"),
        F.when(short, F.raise_error(F.lit("a split is shorter than the overlap"))).otherwise(F.coalesce(F.lead("head").over(order), F.lit(""))).alias("behind"),
    )
    rows = local.join(placed, ["file", "block"])  # sent to all where its size, known by then, is small
    continued = F.col("idx") == 0
    at = F.col("first") + F.col("idx")
    idx = F.when(at < 0, F.raise_error(F.concat("file", F.lit(": bases before the first header")))).otherwise(at)
    text = F.when(F.col("open") & (F.lit(overlap) > 0), F.concat("sequence", "behind")).otherwise(F.col("sequence"))
    return rows.select("file", idx.cast("int").alias("contig_idx"), F.when(continued, F.col("current")).otherwise(F.col("name")).alias("chrom"), (F.col("base") + F.when(continued, F.col("offset")).otherwise(0)).alias("base"), "own", text.alias("sequence"))


def contig_lengths(fasta: DataFrame) -> DataFrame:
    return fasta.groupBy("file", "contig_idx", "chrom").agg(F.sum("own").alias("length"))


def whole_contigs(fasta: DataFrame) -> DataFrame:
    """(file, contig_idx, chrom, sequence) for contigs that fit a row."""
    parts = fasta.groupBy("file", "contig_idx", "chrom").agg(F.array_sort(F.collect_list(F.struct("base", F.expr("substring(sequence, 1, cast(own as int))").alias("s")))).alias("p"))
    return parts.select("file", "contig_idx", "chrom", F.array_join("p.s", "").alias("sequence"))
