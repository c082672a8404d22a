"""Reports how a panel of primer pairs does on every haplotype of a collection.

    python -m jobs.panel_report --contigs PATH --targets PATH --out PATH --config jobs/panel_report.json

Reads contigs and targets as Parquet.  The configuration says by SQL expressions which
columns are haplotype, contig name and bases, how a target gives its pair, when a haplotype
counts as projected and a product as on target.  Every pair is searched in all contigs, its
products paired, and a cell decided for each haplotype; pairs are ranked over all.

Writes Parquet partitioned by haplotype.  A rerun replaces the partitions of the haplotypes
that it read, so that it can be repeated after a failure; haplotypes that are no longer in
the input keep their last report, and a run without contigs or pairs writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from primeweft.functions.thermo import oligo_tm
from primeweft.operators import pcr

from .common import command, evaluation, load, log, table

COLUMNS = "pair string, status string, reason string, n_products long, n_on long, on_sizes string, off_sizes string, rank long, passed boolean, coverage double, unique_rate double, haplotype long"


def report(contigs: DataFrame, pairs: DataFrame, config: dict) -> DataFrame:
    """A row for each pair and haplotype, with the rank of the pair."""
    rules = evaluation(config)
    searched = contigs.select("haplotype", "chrom", F.col("chrom").alias("contig_idx"), "sequence")
    sites = pcr.judged(pairs, searched, rules)
    # every pair is judged on every haplotype: both tables are small by nature
    cells = pairs.select("pair").join(contigs.select("haplotype").distinct(), how="cross").withColumn("projected", F.expr(config["projected"]))
    grid = pcr.gridded(sites, cells, rules.max_sites)
    lengths = contigs.select("chrom", F.length("sequence").alias("length"))
    products = pcr.products_of(sites, grid, rules).join(lengths, "chrom").withColumn("on_target", F.expr(config["on_target"]))
    decided = pcr.decided(sites, grid, products)
    penalty = F.round(F.abs(oligo_tm(F.col("forward")) - config["tm_opt"]) + F.abs(oligo_tm(F.col("reverse")) - config["tm_opt"]), 6)
    metrics = pcr.cell_summary(decided, ["pair"]).join(pairs.select("pair", penalty.alias("penalty")), "pair")
    ranked = pcr.rank(metrics, pcr.Ranking(**config["ranking"])).select("pair", F.col("rank").cast("long").alias("rank"), "passed", "coverage", "unique_rate")
    sizes = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return decided.select("pair", "status", "reason", "n_products", "n_on", sizes("on_sizes"), sizes("off_sizes"), "haplotype").join(ranked, "pair")


def run(spark: SparkSession, contigs: str, targets: str, out: str, config: str) -> dict:
    """Reads, reports and writes; gives the numbers of rows that were read and written."""
    settings = load(spark, config)
    wrote = Observation("wrote")
    given = table(spark.read.parquet(contigs), settings["contigs"])
    pairs = table(spark.read.parquet(targets), settings["pairs"], settings.get("pairs_where"))
    numbers = {"pairs": pairs.count(), "contigs": given.count(), "rows": 0}
    log.info("read %s: %d primer pairs", targets, numbers["pairs"])
    log.info("read %s: %d contigs", contigs, numbers["contigs"])
    if not numbers["pairs"] or not numbers["contigs"]:
        log.info("wrote nothing")
        return numbers
    rows = report(given, pairs, settings).select(*[c.split()[0] for c in COLUMNS.split(", ")]).observe(wrote, F.count(F.lit(1)).alias("n"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("haplotype").parquet(out)
    numbers["rows"] = wrote.get["n"]
    log.info("wrote %s: %d rows by haplotype", out, numbers["rows"])
    return numbers


def written(spark: SparkSession, out: str) -> DataFrame:
    """What the job has written."""
    return spark.read.schema(COLUMNS).parquet(out)


if __name__ == "__main__":
    command(__doc__, ["contigs", "targets", "out", "config"], run)
