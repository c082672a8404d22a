"""Queries that go through files: the tables are written in a format and read back by its reader.

SQL computes the same from the tables themselves, so that a writer and a reader that
agree on a fault are still told apart from right ones.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import flanked, haplotype_id
from ..operators import project
from ..scratch import path_of
from ..ship import ship
from ..sources import fetch, readers
from . import tables as t
from .catalog import query

#: Bases of a line.
LINE = 60


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a written folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in found if f.getLen() and not f.getPath().getName().startswith(("_", ".")))


def _fasta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of text for each document: header and lines of its sequence."""
    c = t.contigs(spark, sf_dir)
    lines = F.regexp_replace("sequence", f"(.{{{LINE}}})(?=.)", "$1\n")
    return c.select(F.concat(F.lit(">d"), F.col("contig").cast("string"), F.lit(" a document"), F.when(F.length("sequence") > 0, F.concat(F.lit("\n"), lines)).otherwise("")).alias("value"))


def _digests(spark: SparkSession, files: list[str]) -> DataFrame:
    found = readers.whole_contigs(readers.read_fasta(spark, files, 1000, 30, 1 << 16))
    return found.select(F.expr("cast(substring(chrom, 2) as bigint)").alias("doc_id"), F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("digest"))


_SQL_DIGESTS = f"SELECT doc_id, length(s)::BIGINT AS n, md5(s) AS digest FROM (SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE {t.sql_encode('text')} END AS s FROM documents)"


@query(_SQL_DIGESTS)
def fasta_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain FASTA, split and cut into chunks of 1000 bases, put together again."""
    folder = path_of(spark, "plain-fasta")
    _fasta_text(spark, sf_dir).write.text(folder)
    return _digests(spark, files_in(spark, folder))


def write_blocked(lines: DataFrame, folder: str, size: int = 20_000) -> list[str]:
    """Writes rows of text as blocked gzip files, one for each partition, in members of ``size`` bytes of text; their paths."""

    def member(raw: bytes) -> bytes:
        press = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = press.compress(raw) + press.flush()
        n = len(body) + 25
        return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + n.to_bytes(2, "little") + body + zlib.crc32(raw).to_bytes(4, "little") + len(raw).to_bytes(4, "little")

    def write(batches):
        from pyarrow import fs

        context = TaskContext.get()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        held = bytearray()
        with system.open_output_stream(f"{path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.fa.gz", compression=None) as out:
            for batch in batches:
                held += "".join(x + "\n" for x in batch.column(0).to_pylist()).encode()
                whole = len(held) // size * size
                for a in range(0, whole, size):
                    out.write(member(bytes(held[a : a + size])))
                del held[:whole]
            if held:
                out.write(member(bytes(held)))
            out.write(member(b""))
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{context.partitionId():05d}-{context.taskAttemptId()}.fa.gz"])], names=["file"])

    ship(lines.sparkSession)
    return [f"{folder}/{r['file']}" for r in lines.mapInArrow(write, "file string").collect()]  # a row for each file


@query(_SQL_DIGESTS)
def fasta_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked gzip, read by ranges of members."""
    files = write_blocked(_fasta_text(spark, sf_dir), path_of(spark, "blocked-fasta"))
    return _digests(spark, files)


@query(f"SELECT count(*)::BIGINT AS n_contigs, sum(n)::BIGINT AS n_bases FROM ({_SQL_DIGESTS})")
def genome_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = path_of(spark, "sized-fasta")
    _fasta_text(spark, sf_dir).write.text(folder)
    lengths = readers.contig_lengths(readers.read_fasta(spark, files_in(spark, folder)))
    return lengths.agg(F.count(F.lit(1)).alias("n_contigs"), F.sum("length").alias("n_bases"))


@query(
    "SELECT 'q' || l_orderkey AS q_name, l_partkey::BIGINT AS q_start, (l_partkey + 400)::BIGINT AS q_end, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, 'chr' || (l_suppkey % 5) AS t_name, (l_orderkey * 10)::BIGINT AS t_start, (l_orderkey * 10 + 390)::BIGINT AS t_end, (l_linenumber * 10)::BIGINT AS mapq, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linenumber || 'M390I' END AS cigar FROM lineitem WHERE l_suppkey % 5 = 3 AND l_orderkey * 10 < 40000 AND l_orderkey * 10 + 390 > 10000"
)
def paf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments as text, some lines short or without operations, read for one interval."""
    l = t.read(spark, sf_dir, "lineitem")  # noqa: E741
    c = lambda x: (F.lit(x) if isinstance(x, str) else x.cast("string"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    columns = [F.concat(F.lit("q"), o), "9999", F.col("l_partkey"), F.col("l_partkey") + 400, F.when(n % 2 == 0, "-").otherwise("+"), F.concat(F.lit("chr"), F.col("l_suppkey") % 5), "99999", o * 10, o * 10 + 390, "380", "400", n * 10]
    tags = F.when(n % 3 == 0, "tp:A:P").otherwise(F.concat(F.lit("tp:A:P\tcg:Z:"), n, F.lit("M390I")))
    whole = F.concat_ws("\t", *[c(x) for x in columns], tags)
    folder = path_of(spark, "paf")
    l.select(F.explode(F.array(whole, F.lit("short\tline"))).alias("value")).write.text(folder)
    found = readers.read_paf(spark, folder, "chr3", 10_000, 40_000)
    return found.select("q_name", "q_start", "q_end", "strand", "t_name", "t_start", "t_end", "mapq", F.coalesce("cigar", F.lit("")).alias("cigar"))


@query(f"WITH {t.SQL_PAIRS} SELECT pair AS primer_id, 'chr1:' || candidate_idx || '-' || (candidate_idx + 100) AS target, forward, reverse FROM pr")
def primer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with other column names, lower case, spaces and rows without id."""
    p = t.pairs(spark, sf_dir)
    locus = F.concat(F.lit("chr1:"), "candidate_idx", F.lit("-"), F.col("candidate_idx") + 100)
    rows = p.select(F.concat(F.lit(" "), "pair", F.lit(" ")).alias("Name"), locus.alias("coords"), F.lower("forward").alias("FWD"), F.concat("reverse", F.lit("  ")).alias("Rev"))
    folder = path_of(spark, "primers")
    rows.unionByName(rows.limit(3).withColumn("Name", F.lit("  "))).coalesce(1).write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(folder)
    return readers.read_primers(spark, folder)


@query("SELECT 's' || c_custkey || '#hap' || k AS haplotype, '/data/s' || c_custkey || '_hap' || k || '.fa.gz' AS fasta FROM customer, (SELECT unnest([1, 2]) AS k)")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with a header, comments and blank lines."""
    c = t.read(spark, sf_dir, "customer").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    sample = F.concat(F.lit("s"), "c_custkey")
    line = F.concat_ws("\t", sample, F.col("k").cast("string"), F.lit("AFR"), F.concat(F.lit("/data/"), sample, F.lit("_hap"), F.col("k"), F.lit(".fa.gz")), F.lit("PENDING"))
    noise = spark.createDataFrame([("sample\thap\tsuperpop\tlocal_path\tmd5",), ("# a comment\t1\tx\ty",), ("",), ("   ",)], "value string")
    folder = path_of(spark, "manifest")
    c.select(line.alias("value")).unionByName(noise).write.text(folder)
    return readers.read_manifest(spark, folder, check=False).withColumn("haplotype", haplotype_id(F.split("haplotype", "#hap")[0], F.split("haplotype", "#hap")[1]))


_SQL_ANCHORS = "SELECT 'chr' || (l_suppkey % 7) AS t_name, (l_orderkey * 7)::BIGINT AS t_start, (l_orderkey * 7 + 1000)::BIGINT AS t_end, 'q' || (l_partkey % 3) AS q_contig, l_partkey::BIGINT AS q_start, (l_partkey + 990)::BIGINT AS q_end, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand FROM lineitem"


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t.read(spark, sf_dir, "lineitem")  # noqa: E741
    at, q = F.col("l_orderkey") * 7, F.col("l_partkey").cast("long")
    return l.select(F.concat(F.lit("chr"), F.col("l_suppkey") % 7).alias("t_name"), at.alias("t_start"), (at + 1000).alias("t_end"), F.concat(F.lit("q"), F.col("l_partkey") % 3).alias("q_contig"), q.alias("q_start"), (q + 990).alias("q_end"), F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise("+").alias("strand"))


@query(_SQL_ANCHORS)
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor grid as its writer makes it, read back."""
    folder = path_of(spark, "grid")
    readers.write_grid(_anchors(spark, sf_dir), folder, {"step": 7, "probe": 1000})
    anchors, metadata = readers.read_grid(spark, folder)
    if metadata != {"step": "7", "probe": "1000"}:
        raise ValueError(f"the grid's metadata are {metadata}")
    return anchors.drop("path")


@query(f"SELECT 3 * count(*) AS n_probes, count(*)::BIGINT AS n_anchors, round(count(*)::DOUBLE / (3 * count(*)), 6) AS anchored FROM ({_SQL_ANCHORS})")
def grid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _anchors(spark, sf_dir)
    probes = anchors.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return project.grid_statistics(probes, anchors).select("n_probes", "n_anchors", F.round("anchored", 6).alias("anchored"))


@query("SELECT o_orderkey, greatest(0, o_custkey - 250)::BIGINT AS start, least(1000, o_custkey + 300 + 250)::BIGINT AS stop, greatest(2000, 300 + o_custkey + 250)::BIGINT AS most FROM orders")
def padded_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci widened within a contig of 1000 bases, and the largest product that counts."""
    from .verify import PAD, most_product

    o = t.read(spark, sf_dir, "orders")
    start, stop = flanked(F.col("o_custkey").cast("long"), F.col("o_custkey").cast("long") + 300, PAD, F.lit(1000).cast("long"))
    return o.select("o_orderkey", start.alias("start"), stop.alias("stop"), most_product(F.lit(300) + F.col("o_custkey"), 2000).cast("long").alias("most"))


@query("SELECT c_custkey AS sample_id, k::BIGINT AS haplotype FROM customer, (SELECT unnest([1, 2]) AS k) ORDER BY c_custkey, k LIMIT 25")
def manifest_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All haplotypes by sample and number, cut at a limit, which is the feature."""
    c = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("haplotype"))
    return readers.by_sample(c, 25)


@query("SELECT sample_id, haplotype FROM (VALUES " + ", ".join(f"('{s}', 1::BIGINT)" for s in fetch.DEFAULT_SAMPLES) + ") v(sample_id, haplotype)")
def default_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default haplotypes, found among the customers' ones and second haplotypes of their own."""
    c = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.lit(1).cast("long").alias("haplotype"))
    own = spark.createDataFrame([(s, h) for s in fetch.DEFAULT_SAMPLES for h in (1, 2)], "sample_id string, haplotype long")
    return fetch.default_subset(c.unionByName(own))
