"""The stages of a design as steps of their own, with JSON records between them.

A workflow runs one step for each record: ``anchor`` once, ``project`` for each
haplotype, ``design_candidates`` and ``stage_a`` over all projections, ``evaluate`` for
each haplotype, ``aggregate`` over all results.  Records are small; contigs are read by
Spark where a step needs them.
"""

from __future__ import annotations

import json
import pathlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, design, mask, pcr, project
from . import verify as plans

_PAIRS = "pair string, candidate_idx int, forward string, reverse string, left_start int, left_length int, right_start int, right_length int, product int, penalty double"


def load(path: str) -> dict:
    return json.loads(pathlib.Path(path).read_text())


def save(record: dict, path: str) -> None:
    pathlib.Path(path).write_text(json.dumps(record))


# ---------------------------------------------------------------- records
def pair_record(r: dict) -> dict:
    """A candidate as a record."""
    sides = {side: {"name": f"{r['pair']}_{side[0].upper()}", "sequence": r[side]} for side in ("forward", "reverse")}
    return {"pair": {"name": r["pair"], **sides, "product_size_chm13": r["product"]}, "left_start": r["left_start"], "left_len": r["left_length"], "right_start": r["right_start"], "right_len": r["right_length"], "penalty": r["penalty"]}


def pairs_of(spark: SparkSession, candidates: dict) -> DataFrame:
    """The candidates of a record as a table, in their order."""
    rows = []
    for i, c in enumerate(candidates["candidates"]):
        p = c["pair"]
        rows.append((p["name"], i, p["forward"]["sequence"], p["reverse"]["sequence"], c["left_start"], c["left_len"], c["right_start"], c["right_len"], p["product_size_chm13"], float(c["penalty"])))
    return spark.createDataFrame(rows, _PAIRS)


def windows_of(spark: SparkSession, projections: Iterable[dict]) -> tuple[DataFrame, DataFrame]:
    """(windows (haplotype, chrom, contig_idx, sequence) of what was projected, haplotypes with the length of their window or null)."""
    each = [(p["hap_id"], p["hap_seq"] if p["locus"] else None) for p in projections]
    windows = spark.createDataFrame([(h, "window", 0, s) for h, s in each if s is not None], "haplotype string, chrom string, contig_idx int, sequence string")
    return windows, spark.createDataFrame([(h, None if s is None else len(s)) for h, s in each], "haplotype string, length long")


def results_of(cells: DataFrame) -> dict[str, dict]:
    """For each haplotype its record of cells (with their products)."""
    out: dict[str, dict] = {}
    for c in cells.orderBy("haplotype", "pair").collect():  # a row for each pair and haplotype
        amplicons = [{"haplotype_id": c["haplotype"], **x.asDict()} for x in c["products"]]
        own = out.setdefault(c["haplotype"], {"hap_id": c["haplotype"], "per_pair": {}})
        own["per_pair"][c["pair"]] = {"haplotype_id": c["haplotype"], "status": c["status"], "reason": c["reason"], "amplicons": amplicons}
    return out


def cells_of(spark: SparkSession, results: Iterable[dict]) -> DataFrame:
    """Cells of result records, with what metrics need."""
    rows = []
    for r in results:
        for name, c in r["per_pair"].items():
            sizes = {on: sorted(a["size"] for a in c["amplicons"] if a["on_target"] is on) for on in (True, False)}
            rows.append((name, c["haplotype_id"], c["status"], c["reason"], len(sizes[True]), len(c["amplicons"]), sizes[True], sizes[False], "binding sites" in (c["reason"] or "")))
    return spark.createDataFrame(rows, "pair string, haplotype string, status string, reason string, n_on long, n_products long, on_sizes array<long>, off_sizes array<long>, capped boolean")


# ---------------------------------------------------------------- steps
def anchor(spark: SparkSession, target: DataFrame, backbone: DataFrame, flank: int) -> dict:
    """Where a target (target, text, bases) lies on the backbone, and the template: the locus with its flanks."""
    at = plans.anchored(target, backbone)
    wide = plans.widened(at, project.lengths_of(backbone, []), flank)
    template = project.fetch(wide.select("target", F.col("chrom").alias("q_name"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.lit("+").alias("strand")), backbone, [])
    core, cut = at.first(), template.first()
    if cut is None:
        raise ValueError("the backbone doesn't have the target's contig")
    return {"chrom": core["chrom"], "start": core["start"], "end": core["end"], "tstart": cut["lo"], "tend": cut["hi"], "template": cut["bases"]}


def project_one(spark: SparkSession, anchored: dict, haplotype: str, fasta: str, contigs: DataFrame, blocks: DataFrame | None, grids: DataFrame | None) -> dict:
    """The target on one haplotype, by the first route that it has."""
    target = spark.createDataFrame([("target", anchored["chrom"], anchored["tstart"], anchored["tend"])], "pair string, chrom string, start long, end long")
    bases = spark.createDataFrame([("target", anchored["template"])], "pair string, bases string")
    one = spark.createDataFrame([(haplotype,)], "haplotype string")
    found = plans.projected(target, one, contigs, blocks, None, grids, bases).first()
    if found["chrom"] is None:
        return {"hap_id": haplotype, "fasta": fasta, "locus": None, "hap_seq": "", "reason": found["reason"]}
    place = spark.createDataFrame([(haplotype, found["chrom"], found["start"], found["end"], found["strand"])], "haplotype string, q_name string, lo long, hi long, strand string")
    cut = project.fetch(place, contigs, ["haplotype"], orient=True).first()
    return {"hap_id": haplotype, "fasta": fasta, "locus": {"assembly": fasta, "chrom": found["chrom"], "start": cut["lo"], "end": cut["hi"]}, "hap_seq": cut["bases"], "reason": found["reason"]}


def design_candidates(spark: SparkSession, anchored: dict, projections: list[dict], raw: dict) -> dict:
    """Variable positions of all projections, and primer pairs that avoid them."""
    name = f"{anchored['chrom']}_{anchored['start']}"
    template = spark.createDataFrame([(name, anchored["template"])], "template string, sequence string")
    windows, _ = windows_of(spark, projections)
    zones = plans.masked(template, align.align_windows(template, windows), raw)
    found = design.candidates(template, zones, plans.design_of(raw)).orderBy("candidate_idx").collect()
    excluded = [[r["start"], r["length"]] for r in zones.orderBy("start").collect()]
    return {"excluded": excluded, "candidates": [pair_record(r.asDict()) for r in found]}


def stage_a(spark: SparkSession, candidates: dict, projections: list[dict], raw: dict, top_k: int | None) -> dict:
    """The candidates that cover most of the projected windows, and the coverage of all."""
    pairs = pairs_of(spark, candidates)
    windows, haplotypes = windows_of(spark, projections)
    # every candidate is tried on every window: both tables are small by nature
    loci = pairs.select("pair").join(haplotypes, how="cross").select("pair", "haplotype", F.when(F.col("length").isNotNull(), "window").alias("chrom"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    covered = pcr.cell_summary(pcr.evaluate(pairs, windows, loci, plans.config_of(raw)), ["pair"]).join(pairs.select("pair", "penalty", "candidate_idx"), "pair")
    ranked = [r["pair"] for r in pcr.shortlist(covered, top_k).collect()]
    by_name = {c["pair"]["name"]: c for c in candidates["candidates"]}
    return {"candidates": [by_name[n] for n in ranked], "stage_a_coverage": {r["pair"]: round(r["coverage"], 4) for r in covered.orderBy("candidate_idx").collect()}}


def evaluate_one(spark: SparkSession, candidates: dict, projection: dict, contigs: DataFrame, raw: dict) -> dict:
    """All candidates against one whole haplotype."""
    pairs, locus = pairs_of(spark, candidates), projection["locus"]
    place = (locus["chrom"], locus["start"], locus["end"]) if locus else (None, None, None)
    where = spark.createDataFrame([(projection["hap_id"], *place)], "haplotype string, chrom string, start long, end long")
    cells = pcr.evaluate(pairs, contigs, pairs.select("pair").join(where, how="cross"), plans.config_of(raw))
    return results_of(cells).get(projection["hap_id"], {"hap_id": projection["hap_id"], "per_pair": {}})


def aggregate(spark: SparkSession, candidates: dict, results: list[dict], raw: dict) -> tuple[DataFrame, DataFrame]:
    """(cells, ranked) of all haplotypes' results."""
    pairs = pairs_of(spark, candidates)
    cells = cells_of(spark, results).join(pairs.select("pair"), "pair", "left_semi")
    return cells, pcr.rank(pcr.cell_summary(cells, ["pair"]).join(pairs, "pair"), plans.ranking_of(raw))


def rehydrated(spark: SparkSession, saved: dict, raw: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, metrics) of a saved report, computed anew from its cells; a design's pairs are ranked anew."""
    cell = "pair string, haplotype string, status string, reason string, n_on long, n_products long, on_sizes array<long>, off_sizes array<long>, capped boolean, size_flag boolean"
    rows = [(p["pair"], str(c["haplotype"]), c["status"], c["reason"], c["n_on"], c["n_products"], c["on_sizes"], c["off_sizes"], c["capped"], c.get("size_flag")) for p in saved["pairs"] for c in p["cells"]]
    cells = spark.createDataFrame(rows, cell)
    kept = ["forward", "reverse", "product", "penalty", "expected_size", "target", "target_chm13", "design_tm"]
    facts = spark.createDataFrame([(p["pair"], *[None if p.get(k) is None else str(p[k]) for k in kept]) for p in saved["pairs"]], ", ".join(f"`{k}` string" for k in ["pair", *kept]))
    numbers = {"product": "long", "penalty": "double", "expected_size": "long", "design_tm": "double"}
    facts = facts.select("pair", *[F.col(k).cast(numbers.get(k, "string")).alias(k) for k in kept])
    metrics = pcr.cell_summary(cells, ["pair"]).join(facts, "pair")
    return cells, pcr.rank(metrics, plans.ranking_of(raw or {})) if "passed" in (saved["pairs"] or [{}])[0] else metrics


# ---------------------------------------------------------------- comparison
def compared(expected: DataFrame, found: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, side, fields) of the rows that two tables don't have in common.

    ``side`` is missing, new or differs; ``fields`` names the columns that differ.  Keys
    and fields are compared null-safe, and a key that is repeated meets all its rows.
    """
    wide = lambda df, name: df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*fields).alias(name))
    a, b = wide(expected, "a"), wide(found, "b")
    same = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    differing = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields]))
    side = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.size(differing) > 0, "differs")
    told = a.join(b, on, "full").select(*[F.when(F.col("a").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys], side.alias("side"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), differing).otherwise(F.array().cast("array<string>")).alias("fields"))
    return told.where("side is not null")


_FACTS = ("forward", "reverse", "target", "target_chm13", "expected_size", "product", "passed", "evaluable", "n_uncertain", "n_dropout", "n_off_target", "n_multi_product")
_CELL = ("status", "on_sizes", "off_sizes", "size_flag", "capped")


def differences(expected: dict, found: dict) -> list[str]:
    """What two saved reports don't have in common, cell by cell; reasons are free text and don't count."""
    out = []

    def keyed(a: list[dict], b: list[dict], key: str, what: str) -> list[tuple[str, dict, dict]]:
        left, right = ({str(x[key]): x for x in xs} for xs in (a, b))
        out.extend(f"{what} {k} is missing" for k in sorted(left.keys() - right.keys()))
        out.extend(f"{what} {k} is new" for k in sorted(right.keys() - left.keys()))
        return [(k, left[k], right[k]) for k in sorted(left.keys() & right.keys())]

    for name, a, b in keyed(expected["pairs"], found["pairs"], "pair", "pair"):
        out += [f"pair {name}: {f} is {b.get(f)!r}, not {a.get(f)!r}" for f in _FACTS if a.get(f) != b.get(f)]
        for hap, x, y in keyed(a["cells"], b["cells"], "haplotype", f"pair {name}: haplotype"):
            out += [f"pair {name}, haplotype {hap}: {f} is {y.get(f)!r}, not {x.get(f)!r}" for f in _CELL if x.get(f) != y.get(f)]
    return out
