"""The two whole plans: verifying given primers, and designing new ones."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import flanked, parse_locus, revcomp_text
from ..functions.thermo import pair_tm
from ..operators import design, mask, pcr, project

# Fixed values of verification: least product; what a product may exceed the expected one by, and
# by how much a target is widened on both sides before it is projected.
LEAST_PRODUCT, PAD = 40, 250


class AmbiguousAnchor(ValueError):
    """A target maps about equally well to several places."""


def config_of(raw: dict, mode: str | None = None, design_tm: float | None = None) -> pcr.Evaluation:
    """Evaluation parameters of a configuration; sections left out keep their defaults."""
    from ..functions.thermo import Conditions

    drop, search, d = raw.get("dropout") or {}, raw.get("search") or {}, raw.get("design") or {}
    rule, thermo = drop.get("rule") or {}, drop.get("thermo") or {}
    base = pcr.Evaluation()
    conditions = Conditions(thermo.get("mv_conc", 50.0), thermo.get("dv_conc", 1.5), thermo.get("dntp_conc", 0.6), thermo.get("dna_conc", 250.0))
    return pcr.Evaluation(
        mode or drop.get("mode", base.mode),
        search.get("max_mismatches", base.max_mismatches),
        d.get("product_size_min", base.min_product),
        d.get("product_size_max", base.max_product),
        search.get("max_binding_sites", base.max_sites),
        pcr.Rule(rule.get("max_total_mm", 2), rule.get("max_3prime_mm", 0), rule.get("suffix", 5)),
        pcr.Thermo(design_tm, thermo.get("tm_drop_max", 5.0), thermo.get("three_prime_hard_nt", 2), conditions),
    )


def ranking_of(raw: dict) -> pcr.Ranking:
    r = raw.get("rank") or {}
    return pcr.Ranking(r.get("min_coverage", 0.95), r.get("max_off_target", 0), r.get("max_multi_product", 0), r.get("min_evaluable", 1))


def design_of(raw: dict) -> design.Design:
    d, base = raw.get("design") or {}, design.Design()
    names = {"product_min": "product_size_min", "product_max": "product_size_max", "length_min": "primer_len_min", "length_opt": "primer_len_opt", "length_max": "primer_len_max", "tm_min": "primer_tm_min", "tm_opt": "primer_tm_opt", "tm_max": "primer_tm_max", "n_candidates": "n_candidates"}
    return design.Design(**{k: d.get(v, getattr(base, k)) for k, v in names.items()})


def anchored(targets: DataFrame, backbone: DataFrame) -> DataFrame:
    """(target, chrom, start, end): coordinates as they are, sequences (bases) by shared k-mers.

    A sequence without a place, or with two about as good, raises.
    """
    given = targets.where("bases is null").withColumn("l", parse_locus(F.col("text"))).select("target", "l.chrom", "l.start", "l.end")
    bad = given.where("chrom is null or `end` < start").select("target").limit(5).collect()
    if bad:
        raise ValueError("no locus: " + ", ".join(r["target"] for r in bad))
    sought = targets.where("bases is not null")
    placed = project.chain_projection(sought.select("target", "bases"), backbone, [], frac=0.9)
    names = {r["target"] for r in sought.select("target").collect()}  # a row for each target of a run
    rows = placed.collect()
    if names - {r["target"] for r in rows}:
        raise ValueError("no place on the backbone for " + ", ".join(sorted(names - {r["target"] for r in rows})))
    place = lambda x: f"{x['chrom']}:{x['start']}-{x['end']}"
    if doubtful := [r for r in rows if r["ambiguous"]]:
        raise AmbiguousAnchor("several places for " + "; ".join(f"{r['target']}: " + ", ".join([place(r), *map(place, r["rivals"])]) for r in doubtful))
    if unsure := [r["target"] for r in rows if r["mapq"] < project.ANCHOR_MAPQ]:
        raise ValueError("no sure place on the backbone for " + ", ".join(unsure))
    return given.unionByName(placed.select("target", "chrom", "start", "end"))


def widened(targets: DataFrame, lengths: DataFrame, pad: int = PAD) -> DataFrame:
    """``targets`` (chrom, start, end and more) with ``pad`` bases more on both sides, within their contig (chrom, length)."""
    wide = targets.join(lengths.select("chrom", F.col("length").cast("long").alias("length")), "chrom")
    lo, hi = flanked(F.col("start"), F.col("end"), pad, F.col("length"))
    return wide.withColumns({"start": lo, "end": hi}).drop("length")


def projected(targets: DataFrame, haplotypes: DataFrame, contigs: DataFrame, blocks: DataFrame | None, backbone: DataFrame | None, grids: DataFrame | None = None, bases: DataFrame | None = None) -> DataFrame:
    """(pair, haplotype, chrom, start, end, strand, reason) of every target on every haplotype; no chrom: not projectable.

    Haplotypes with alignment blocks are lifted, those with an anchor grid sought in the
    window that it gives, the others placed by shared k-mers of the whole assembly.
    Lifted targets keep the block's strand; the others are taken as they lie.  The
    targets' bases (pair, bases) come from the backbone where they aren't given.
    """
    every = haplotypes.select("haplotype").distinct()
    marks = lambda df, name: every.join(df.select("haplotype").distinct().withColumn(name, F.lit(True)), "haplotype", "left") if df is not None else every.withColumn(name, F.lit(None).cast("boolean"))
    routes = marks(blocks, "has_blocks").join(marks(grids, "has_grid"), "haplotype")
    by = F.when(F.coalesce("has_blocks", F.lit(False)), project.route(True, False)).when(F.coalesce("has_grid", F.lit(False)), project.route(False, True)).otherwise(project.route(False, False))
    # every target is sought on every haplotype: both tables are small by nature
    cells = targets.join(routes.select("haplotype", by.alias("route")), how="cross")
    on = lambda name: cells.where(F.col("route") == name)
    if bases is None:
        wanted = targets.select(F.col("pair").alias("target"), F.col("chrom").alias("q_name"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.lit("+").alias("strand"))
        bases = project.fetch(wanted, backbone, []).select(F.col("target").alias("pair"), "bases")
    places = ["pair", "haplotype", "chrom", "start", "end", "strand", "why"]
    unturned = lambda df, why: df.withColumn("strand", F.lit("+")).withColumn("why", F.lit(why) if isinstance(why, str) else why)
    sought = on("kmers").select("haplotype", F.col("pair").alias("target"), "pair").join(bases, "pair").drop("pair")
    columns = ["haplotype", "chrom", "sequence", *(["base", "own"] if project.is_cut(contigs) else [])]
    found = unturned(project.chain_projection(sought, contigs.select(*columns), ["haplotype"]).where(F.col("mapq") >= project.MAPQ).withColumnRenamed("target", "pair").drop("strand"), "ok").select(*places)
    if blocks is not None:
        lifted = project.project_blocks(on("blocks").select("pair", "haplotype", "chrom", "start", "end"), blocks, ["pair", "haplotype"])
        found = found.unionByName(lifted.select("pair", "haplotype", F.col("q_name").alias("chrom"), F.col("lo").alias("start"), F.col("hi").alias("end"), "strand", F.lit("paf-cache").alias("why")))
    if grids is not None:
        own = on("grid").join(bases, "pair").withColumnRenamed("pair", "target").select("haplotype", "target", "chrom", "start", "end", "bases")
        in_window = project.project_grid(own, grids, contigs.select(*columns), ["haplotype"])
        found = found.unionByName(unturned(in_window.withColumnRenamed("target", "pair"), F.col("reason")).select(*places))
    missing = F.when(F.col("route") == "blocks", "no cached alignment block covers the target").otherwise("target did not map confidently to this haplotype")
    return cells.select("pair", "haplotype", "route").join(found, ["pair", "haplotype"], "left").select(*places[:-1], F.coalesce("why", missing).alias("reason"))


def masked(template: DataFrame, alignments: DataFrame, raw: dict) -> DataFrame:
    """(template, start, length) of the regions that primers avoid."""
    m = raw.get("mask") or {}
    n = template.select("template", F.length("sequence").alias("n"))
    marks = mask.variants(alignments.join(n, "template"), F.col("n"))
    aligned = alignments.groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    return mask.excluded_regions(mask.pileup(marks), aligned, m.get("min_allele_freq", 0.05), m.get("merge_gap", 25), m.get("max_regions", mask.MAX_REGIONS)).select("template", "start", "length")


def most_product(expected: Column, max_amplicon: int) -> Column:
    """The largest product that counts: a larger expected one is never filtered out."""
    return F.greatest(F.lit(max_amplicon), expected + PAD)


def verify(pairs: DataFrame, loci: DataFrame, contigs: DataFrame, config: pcr.Evaluation, max_amplicon: int = 2000, tolerance: int = 20, how: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, summary) of given pairs (pair, forward, reverse, expected_size).

    Every pair has a bound of its own, max_amplicon, or its expected product and a pad;
    the haplotypes are searched once for all of them.
    """
    bounded = pairs.withColumn("max_product", most_product(F.col("expected_size"), max_amplicon))
    one = pcr.Evaluation(config.mode, config.max_mismatches, LEAST_PRODUCT, max_amplicon, config.max_sites, config.rule, config.thermo)
    cells = pcr.evaluate(bounded, contigs, loci.join(pairs.select("pair"), "pair", "left_semi"), one, how)
    cells = cells.join(pairs.select("pair", "expected_size"), "pair").withColumn("size_flag", F.exists("on_sizes", lambda x: F.abs(x - F.col("expected_size")) > tolerance))
    from .reports import summary_text

    summary = pcr.cell_summary(cells, ["pair"]).withColumn("summary", summary_text()).join(pairs.select("pair", "expected_size"), "pair")
    return cells, summary


def design_run(template: DataFrame, windows: DataFrame, contigs: DataFrame, loci: DataFrame, alignments: DataFrame, raw: dict, top_k: int | None = 5, how: str | None = None, stage=lambda name, df: df) -> tuple[DataFrame, DataFrame]:
    """(cells, ranked) of primers designed on ``template`` (template, sequence).

    Variable positions are masked, candidates picked and evaluated on the projected
    windows alone; the shortlist then runs against whole haplotypes, a search that
    candidates below it never reach.  ``stage(name, df)`` may write each stage and
    give it back, or an earlier run's.
    """
    picked = stage("candidates", design.candidates(template, stage("regions", masked(template, alignments, raw)), design_of(raw)))
    config = config_of(raw)
    every = picked.select("pair").join(windows.select("haplotype", "chrom", F.lit(0).cast("long").alias("start"), F.length("sequence").cast("long").alias("end")), how="cross")
    stage_a = stage("stage_a", pcr.cell_summary(pcr.evaluate(picked, windows, every, config, how), ["pair"]).join(picked.select("pair", "penalty", "candidate_idx"), "pair"))
    chosen = pcr.shortlist(stage_a, top_k).select("pair")
    kept = picked.join(chosen, "pair", "left_semi")
    cells = stage("cells", pcr.evaluate(kept, contigs, kept.select("pair").join(loci, how="cross"), config, how))
    metrics = pcr.cell_summary(cells, ["pair"]).join(kept.drop("template"), "pair").withColumn("design_tm", pair_tm(F.col("forward"), F.col("reverse")))
    return cells, pcr.rank(metrics, ranking_of(raw))


# ---------------------------------------------------------------- a small built-in example
# The example's primers.
FORWARD, REVERSE = "TTGCACAGTCCAGATTGCAA", "CATTGCGATTGACACTTGCG"


def example(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, contigs, loci): five haplotypes, one for each status."""
    drawn = random.Random(20)
    left, middle, right, spacer = ("".join(drawn.choices("ACGT", k=n)) for n in (30, 100, 25, 600))
    locus = left + FORWARD + middle + revcomp_text(REVERSE) + right
    # without the last base of the forward primer nothing primes here
    broken = locus.replace(FORWARD, FORWARD[:-1] + "C")
    built = {"pass": [locus], "drop": [broken], "off": [broken, locus], "multi": [locus, locus], "unc": [locus]}
    rows = [(f"HG_{name}", spacer.join(copies), len(locus) if name != "unc" else None) for name, copies in built.items()]
    contigs = spark.createDataFrame([(h + "#hap1", "chr1", 0, s) for h, s, _ in rows], "haplotype string, chrom string, contig_idx int, sequence string")
    loci = spark.createDataFrame([("demo", h + "#hap1", "chr1" if n else None, 0 if n else None, n) for h, _, n in rows], "pair string, haplotype string, chrom string, start long, end long")
    return spark.createDataFrame([("demo", FORWARD, REVERSE)], "pair string, forward string, reverse string"), contigs, loci


def example_cells(spark: SparkSession, how: str | None = None) -> DataFrame:
    pairs, contigs, loci = example(spark)
    return pcr.evaluate(pairs, contigs, loci, pcr.Evaluation("rule", min_product=80, max_product=200), how)
