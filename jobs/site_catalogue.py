"""Keeps a catalogue of the binding sites of a primer panel, as new assemblies arrive.

    python -m jobs.site_catalogue --contigs PATH --targets PATH --out PATH --config jobs/site_catalogue.json

Contigs arrive as Parquet files in a folder (or under a pattern like ``in/*.parquet``); files
don't change once they are there.  A run
reads the files that no run before has read, by a file stream whose checkpoint says which
those are, and ends when there are none left.  Sites of both primers of each pair, with
their mismatches and whether they prime, are appended to ``OUT/sites`` as Parquet
partitioned by haplotype: the stream's own log of that folder makes each file's sites count
once, also when a run broke off and is repeated.

The panel of the first run is kept in ``OUT/panel``.  A run with another panel or other
bounds stops, since the files that were read before lack its sites; so does one that finds
sites but no checkpoint.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primeweft.operators import pcr
from primeweft.operators.search import search
from primeweft.sources.readers import exists

from .common import command, evaluation, load, log, table


def sites(contigs: DataFrame, pairs: DataFrame, config: dict) -> DataFrame:
    """Judged sites of a table or stream of contigs (haplotype, chrom, sequence)."""
    rules = evaluation(config)
    primers = pcr.primers_of(pairs).drop("design_tm")
    found = search(contigs, primers.select("query"), rules.max_mismatches).withColumn("end", F.col("start") + F.length("query"))
    ruled = pcr.rule_reason(found.join(primers, "query"), rules.rule)
    offsets = F.array_join(F.transform("offsets_3p", lambda x: x.cast("string")), ",").alias("offsets_3p")
    return ruled.select("pair", "role", "chrom", "strand", "start", "end", "mismatches", offsets, "competent", "reason", "haplotype")


def _same_panel(spark: SparkSession, pairs: DataFrame, rules: str, folder: str) -> None:
    """Keeps the panel of a first run; raises if a later one differs."""
    own = pairs.select("pair", F.upper("forward").alias("forward"), F.upper("reverse").alias("reverse"), F.lit(rules).alias("rules"))
    if not exists(spark, f"{folder}/_SUCCESS"):
        own.write.mode("overwrite").parquet(folder)
        return
    kept = spark.read.schema(own.schema).parquet(folder)
    if own.exceptAll(kept).unionAll(kept.exceptAll(own)).limit(1).count():
        raise ValueError(f"{folder} holds another panel or other bounds: use a new output folder")


def run(spark: SparkSession, contigs: str, targets: str, out: str, config: str, checkpoint: str | None = None) -> dict:
    """Appends the sites of new files; gives the numbers of batches, contigs and sites of this run."""
    settings = load(spark, config)
    checkpoint = checkpoint or f"{out}/checkpoint"
    if exists(spark, f"{out}/sites/_spark_metadata") and not exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{out}/sites was written with another checkpoint than {checkpoint}")
    pairs = table(spark.read.parquet(targets), settings["pairs"], settings.get("pairs_where"))
    _same_panel(spark, pairs, json.dumps(settings["evaluation"], sort_keys=True), f"{out}/panel")
    panel = spark.read.parquet(f"{out}/panel")
    log.info("read %s: %d primer pairs", targets, panel.count())
    stream = spark.readStream.schema(settings["contigs_schema"]).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(contigs)
    new = sites(table(stream, settings["contigs"]), panel, settings)
    counted = new.observe("written", F.count(F.lit(1)).alias("n"))
    query = counted.writeStream.format("parquet").partitionBy("haplotype").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(f"{out}/sites")
    query.awaitTermination()
    steps = [p for p in query.recentProgress if p.numInputRows]
    numbers = {"batches": len(steps), "contigs": sum(p.numInputRows for p in steps), "sites": sum(p.observedMetrics["written"]["n"] for p in steps)}
    log.info("read %s: %d new contigs in %d batches", contigs, numbers["contigs"], numbers["batches"])
    log.info("wrote %s/sites: %d sites by haplotype", out, numbers["sites"])
    return numbers


def written(spark: SparkSession, out: str) -> DataFrame:
    """The whole catalogue."""
    columns = "pair string, role string, chrom long, strand string, start long, end long, mismatches int, offsets_3p string, competent boolean, reason string, haplotype long"
    return spark.read.schema(columns).parquet(f"{out}/sites")


if __name__ == "__main__":
    command(__doc__, ["contigs", "targets", "out", "config", "checkpoint"], run)
