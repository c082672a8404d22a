"""What the jobs share: small configurations, tables by configured columns, and the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from primeweft.operators import pcr

log = logging.getLogger("jobs")


def load(spark: SparkSession, path: str) -> dict:
    """A JSON configuration, from any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def table(df: DataFrame, columns: dict[str, str], where: str | None = None) -> DataFrame:
    """The columns of a configuration (name: SQL expression) of a table."""
    named = df.selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])
    return named.where(where) if where else named


def evaluation(config: dict) -> pcr.Evaluation:
    """Evaluation by mismatch counts with a configuration's bounds."""
    e = config["evaluation"]
    rule = pcr.Rule(e["max_total_mm"], e["max_3prime_mm"], e["suffix"])
    return pcr.Evaluation("rule", e["max_mismatches"], e["product_size_min"], e["product_size_max"], e["max_binding_sites"], rule)


def command(about: str, options: list[str], job: Callable[..., dict], argv: list[str] | None = None) -> None:
    """Runs a job in a session of its own; every option is a path."""
    parser = argparse.ArgumentParser(description=about)
    for name in options:
        parser.add_argument(f"--{name}", required=name != "checkpoint")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        job(spark, **given)
    finally:
        spark.stop()
