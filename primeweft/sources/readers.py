"""Readers of assemblies, manifests, primers, alignments, grids and configuration."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import haplotype_id, upper_ascii
from .fasta import bgzf_members, contig_lengths, inflate_member, qualified, read_fasta, whole_contigs  # noqa: F401

# Accepted column names of primer tables.
PRIMER_ALIASES = {
    "primer_id": ("primer_id", "id", "name", "pair_id"),
    "target": ("target", "coords", "coordinates", "grch38", "region"),
    "forward": ("forward", "fwd", "forward_primer", "f", "left"),
    "reverse": ("reverse", "rev", "reverse_primer", "r", "right"),
}
# The superpopulation of each population code.
POPULATIONS = {
    "YRI": "AFR", "LWK": "AFR", "GWD": "AFR", "MSL": "AFR", "ESN": "AFR", "ASW": "AFR", "ACB": "AFR", "ASL": "AFR", "MKK": "AFR",
    "CEU": "EUR", "TSI": "EUR", "FIN": "EUR", "GBR": "EUR", "IBS": "EUR",
    "CHB": "EAS", "JPT": "EAS", "CHS": "EAS", "CDX": "EAS", "KHV": "EAS",
    "GIH": "SAS", "PJL": "SAS", "BEB": "SAS", "STU": "SAS", "ITU": "SAS",
    "MXL": "AMR", "PUR": "AMR", "CLM": "AMR", "PEL": "AMR",
}
SUPERPOPULATIONS = tuple(dict.fromkeys(POPULATIONS.values()))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan_path(spark: SparkSession, path: str) -> str:
    """The file to scan for an assembly: a .gz itself, else its .gz sibling, else the plain file."""
    tried = [path] if path.endswith(".gz") else [path + ".gz", path]
    for p in tried:
        if exists(spark, p):
            return p
    raise FileNotFoundError("none of " + ", ".join(tried))


def sidecar(spark: SparkSession, path: str, suffix: str) -> str:
    """The file beside an assembly: exact name, else that of the name without .gz, else the exact name to write."""
    for p in (path + suffix, path.removesuffix(".gz") + suffix):
        if exists(spark, p):
            return p
    return path + suffix


def read_manifest(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(haplotype, fasta) of a manifest: blank, comment and header rows don't count."""
    raw = spark.read.text(path).where("trim(value) != '' and not startswith(value, '#')")
    f = F.split("value", "\t")
    rows = raw.select(F.get(f, F.lit(0)).alias("sample"), F.get(f, F.lit(1)).alias("hap"), F.get(f, F.lit(3)).alias("fasta")).where("sample != 'sample'")
    if check:
        for r in rows.select("fasta").distinct().collect():  # a row for each haplotype
            scan_path(spark, r["fasta"])
    return rows.select(haplotype_id(F.col("sample"), F.col("hap")).alias("haplotype"), "fasta")


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    """(primer_id, target, forward, reverse): names by aliases, values trimmed, bases upper-cased, rows without id dropped."""
    raw = spark.read.csv(path, header=True)
    lower = {c.strip().lower(): c for c in raw.columns}
    chosen = {}
    for name, aliases in PRIMER_ALIASES.items():
        found = next((lower[a] for a in aliases if a in lower), None)
        if found is None:
            raise ValueError(f"no column for {name}; one of {', '.join(aliases)} is needed")
        chosen[name] = F.trim(F.coalesce(F.col(f"`{found}`"), F.lit("")))
    rows = raw.select(*[c.alias(n) for n, c in chosen.items()]).where("primer_id != ''")
    return rows.withColumn("forward", upper_ascii(F.col("forward"))).withColumn("reverse", upper_ascii(F.col("reverse")))


def read_paf(spark: SparkSession, path: str | list[str], chrom: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Alignment blocks with path, line_no and cigar; rows of fewer than 12 columns don't count."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).withColumn("line_no", F.monotonically_increasing_id()).where(F.size(f) >= 12)
    tag = F.get(F.filter(F.slice(f, 13, 1 << 20), lambda x: x.startswith("cg:Z:")), F.lit(0))
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.select("path", "line_no", at(0).alias("q_name"), *[at(i).cast("long").alias(n) for i, n in ((2, "q_start"), (3, "q_end"))], at(4).alias("strand"), at(5).alias("t_name"), *[at(i).cast("long").alias(n) for i, n in ((7, "t_start"), (8, "t_end"), (11, "mapq"))], F.substring(tag, F.lit(6), F.length(tag)).alias("cigar"))
    if chrom is not None:
        rows = rows.where(F.col("t_name") == chrom)
    if start is not None and end is not None:
        rows = rows.where((F.col("t_start") < end) & (F.col("t_end") > start))
    return rows


def read_grid(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, dict[str, str]]:
    """(anchors with their path, metadata) of grids; metadata are the key=value pairs of comment lines."""
    raw = spark.read.text(path).withColumn("path", F.input_file_name())
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = raw.where("not startswith(value, '#')").where(F.size(f) >= 7)
    anchors = rows.select("path", at(0).alias("t_name"), at(1).cast("long").alias("t_start"), at(2).cast("long").alias("t_end"), at(3).alias("q_contig"), at(4).cast("long").alias("q_start"), at(5).cast("long").alias("q_end"), at(6).alias("strand"))
    meta = {}
    for r in raw.where("startswith(value, '#')").limit(100).collect():
        meta |= {k: v for k, _, v in (t.partition("=") for t in r["value"][1:].split()) if v}
    return anchors, meta


def write_grid(anchors: DataFrame, path: str, metadata: dict[str, object] | None = None) -> None:
    """Anchors as compressed tab-separated text, sorted over files of about equal ranges; `read_grid` reads the folder.

    A chromosome, however large, is dealt over files by its places, so that no task sorts one alone.
    Metadata are a comment line of their own.  The commit makes the folder appear at once.
    """
    columns = ["t_name", "t_start", "t_end", "q_contig", "q_start", "q_end", "strand"]
    order = ["t_name", "t_start", "q_contig", "q_start"]
    lines = anchors.repartitionByRange(*order).sortWithinPartitions(*order).select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))
    if metadata:
        told = anchors.sparkSession.createDataFrame([("#" + " ".join(f"{k}={v}" for k, v in metadata.items()),)], "value string")
        lines = told.unionByName(lines)
    lines.write.option("compression", "gzip").text(path)


def join_metadata(index: DataFrame, metadata: DataFrame) -> DataFrame:
    """The assembly index with population and superpopulation of each sample; unknown ones are NA and UNK."""
    from ..functions.sequences import s3_to_https

    last = Window.partitionBy("sample_id").orderBy(F.col("line_no").desc())
    meta = metadata if "line_no" in metadata.columns else metadata.withColumn("line_no", F.monotonically_increasing_id())
    meta = meta.withColumn("_i", F.row_number().over(last)).where("_i = 1").select("sample_id", F.trim("population_abbreviation").alias("p"))
    table = F.create_map(*[F.lit(x) for pair in POPULATIONS.items() for x in pair])
    joined = index.join(meta, "sample_id", "left")
    out = joined.withColumn("population", F.when(F.coalesce("p", F.lit("")) == "", "NA").otherwise(F.col("p"))).withColumn("superpop", F.coalesce(F.try_element_at(table, F.coalesce("p", F.lit(""))), F.lit("UNK"))).drop("p")
    for c in ("assembly", "assembly_md5", "assembly_fai"):
        if c in out.columns:
            out = out.withColumn(c, s3_to_https(F.col(c)))
    return out


def select_diverse(records: DataFrame, per: int = 1, superpops: tuple[str, ...] = SUPERPOPULATIONS, haps: tuple[int, ...] | None = None) -> DataFrame:
    """All (or the given) haplotypes of the first ``per`` samples by name of each superpopulation.

    ``records``: sample_id, haplotype, superpop, line_no; a sample's superpopulation is
    that of its first record.
    """
    first = records.withColumn("_i", F.row_number().over(Window.partitionBy("sample_id").orderBy("line_no"))).where("_i = 1").select("sample_id", F.col("superpop").alias("s"))
    order = F.create_map(*[F.lit(x) for i, s in enumerate(superpops) for x in (s, i)])
    chosen = first.where(F.col("s").isin(*superpops)).withColumn("_k", F.row_number().over(Window.partitionBy("s").orderBy("sample_id"))).where(F.col("_k") <= per)
    out = records.join(chosen.select("sample_id", F.element_at(order, F.col("s")).alias("_o")), "sample_id")
    if haps is not None:
        out = out.where(F.col("haplotype").isin(*haps))
    return out.orderBy("_o", "sample_id", "haplotype").drop("_o")


def by_sample(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Records by sample and haplotype, all or the first ones."""
    ordered = records.orderBy("sample_id", "haplotype")
    return ordered.limit(limit) if limit else ordered


def load_config(path: str) -> dict:
    """A YAML configuration from the driver's disk."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def threads(raw: dict) -> int | None:
    """Worker threads of a configuration; 0 and absent mean that Spark decides."""
    n = (raw.get("search") or {}).get("threads")
    return int(n) if n else None


def haplotype_name(path: str) -> str:
    """sample#hapN of a file named sample_hapN.fa(.gz)."""
    m = re.search(r"([^/]+)_hap(\d+)\.fa(\.gz)?$", path)
    if not m:
        raise ValueError(f"{path} isn't named sample_hapN.fa")
    return f"{m[1]}#hap{m[2]}"
