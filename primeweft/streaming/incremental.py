"""New haplotypes as a stream: each micro-batch is evaluated and its cells appended.

Cells are keyed by pair and haplotype and written in a folder for each batch, so
that a repeated batch replaces its own output.  Metrics are aggregated from all
cells when read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import pcr

SCHEMA = "haplotype string, chrom string, contig_idx int, sequence string"


def evaluate_stream(spark: SparkSession, source: str, pairs: DataFrame, loci: DataFrame, config: pcr.Evaluation, cells: str, checkpoint: str) -> StreamingQuery:
    """Evaluates contigs that appear as Parquet in ``source`` once each; ends when all are read.

    ``loci``: at most one row for each pair and haplotype, and those of coming
    haplotypes already in it.
    """

    def batch(contigs: DataFrame, number: int) -> None:
        contigs = contigs.persist()
        own = loci.join(contigs.select("haplotype").distinct(), "haplotype", "left_semi")
        pcr.evaluate(pairs, contigs, own, config).write.mode("overwrite").parquet(f"{cells}/batch={number}")
        contigs.unpersist()

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics(spark: SparkSession, cells: str) -> DataFrame:
    return pcr.cell_summary(spark.read.parquet(cells), ["pair"])
