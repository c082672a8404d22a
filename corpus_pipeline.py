"""The corpus pipeline: quality rules, near duplicates, repeated passages, packing.

Each stage reads what its predecessor kept, takes effect on it and, but for the
last, returns the columns of ``documents``.  A stage's result is to be written before
the next stage is called, as `run` does: the next one deletes the scratch behind it.
"""

from __future__ import annotations

import functools
import threading

import public_tokenizers
from primeweft.llm.op2_quality import keep_good
from primeweft.llm.op3_jaccard import keep_one
from primeweft.llm.op4_substrings import remove_repeats
from primeweft.llm.op6_packing import pack_documents
from primeweft.scratch import discard, named, written
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Near duplicates: five-word shingles and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80
#: Words of a repeated passage.
WINDOW = 20
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Scratch folders of the last stages of each run: by application, thread and input.
_pending: dict[tuple[str, int, str], list[str]] = {}


def _stage(f):
    """A stage that first deletes the scratch of the run's earlier ones, whose results were written.

    Folders that the documents themselves are still read from stay.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        run = (spark.sparkContext.applicationId, threading.get_ident(), sf_dir)
        files = docs.inputFiles()
        before = _pending.pop(run, [])
        over = [p for p in before if not any(p.partition(":")[2].lstrip("/") in x for x in files)]
        discard(spark, over)
        with named() as paths:
            out = f(spark, docs, sf_dir)
        _pending[run] = [p for p in before if p not in over] + paths
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence rules keep."""
    return keep_good(docs.select(COLUMNS))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return keep_one(docs.select(COLUMNS), k=SHINGLE, percent=PERCENT)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of passages that start earlier in the corpus; a text may become empty."""
    kept = remove_repeats(docs.select(COLUMNS), window=WINDOW, texts=True)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4096 ids."""
    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("best-fit packing", packing)]
#: The quality rules' divergences and the packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs, _ = written(docs, f"stage-{number}")
    return docs
