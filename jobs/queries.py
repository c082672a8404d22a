"""The jobs as queries: each runs twice into one new folder, which stays, and gives all that it wrote."""

from __future__ import annotations

import pathlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from primeweft.plans import catalog, tables
from primeweft.scratch import root

from . import panel_report, site_catalogue

_HERE = pathlib.Path(__file__).resolve().parent


def _config(spark: SparkSession, name: str, folder: str) -> str:
    """The configuration that lies beside the job, where all of Spark can read it."""
    text = " ".join((_HERE / f"{name}.json").read_text().split("\n"))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")
    return f"{folder}/config/part-*"


def _twice(job, spark: SparkSession, sf_dir: str, name: str, contigs: str) -> DataFrame:
    folder = f"{root(spark)}/jobs/{name}-{uuid.uuid4().hex}"
    config = _config(spark, name, folder)
    for _ in range(2):
        job.run(spark, f"{sf_dir}/{contigs}", f"{sf_dir}/benchmark.parquet", f"{folder}/out", config)
    return job.written(spark, f"{folder}/out")


def job1_panel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _twice(panel_report, spark, sf_dir, "panel_report", "documents.parquet")


def job2_site_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a table of one file too: a file stream takes folders or patterns
    return _twice(site_catalogue, spark, sf_dir, "site_catalogue", "documents.parque[t]")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_panel_report, job2_site_catalogue)}


_REPORT_SQL = f"""{catalog.SQL_RANKED}
SELECT c.pair, c.status, c.reason, c.n_products::BIGINT AS n_products, c.n_on::BIGINT AS n_on, array_to_string(c.on_sizes, ',') AS on_sizes, array_to_string(c.off_sizes, ',') AS off_sizes,
  r.rank::BIGINT AS rank, r.passed, r.coverage, r.unique_rate, c.haplotype FROM cells c JOIN ranked r USING (pair)"""

_SITES_SQL = f"""WITH {tables.SQL_SITES}
SELECT pair, role, contig AS chrom, strand, start::BIGINT AS start, "end"::BIGINT AS "end", mismatches::INTEGER AS mismatches, array_to_string(offsets_3p, ',') AS offsets_3p, reason = 'ok' AS competent, reason, haplotype FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {"job1_panel_report": _REPORT_SQL, "job2_site_catalogue": _SITES_SQL}
