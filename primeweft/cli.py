"""Command line: whole runs (selftest, design, verify), the stages of a design, and data commands.

Stages: anchor, project, design-candidates, stage-a, evaluate, aggregate; workflow runs
them all.  Data: select (and fetch), grid, prepare (all grids), rerender, compare.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import pathlib
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import align, minimizers, pcr, project
from .plans import reports, stages, verify as plans
from .scratch import discard, path_of, written
from .sources import fetch, readers


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("primeweft").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bases that chunks of contigs overlap by: primers and k-mers are shorter.
OVERLAP = 256


def _chunks(spark: SparkSession, path: str, overlap: int = OVERLAP) -> DataFrame:
    """The contigs of one assembly in chunks."""
    return readers.read_fasta(spark, readers.scan_path(spark, path), overlap=overlap).drop("file")


def _named(spark: SparkSession, rows: list, path_of) -> DataFrame:
    """(haplotype, file) of a manifest's rows: one for each haplotype."""
    return spark.createDataFrame([(r["haplotype"], readers.qualified(spark, path_of(r))) for r in rows], "haplotype string, file string")


def _contigs(spark: SparkSession, manifest: str) -> DataFrame:
    """All contigs of a manifest's assemblies with their haplotype, in chunks, by one plan over all files."""
    rows = readers.read_manifest(spark, manifest).collect()  # a row for each haplotype
    if not rows:
        raise ValueError(f"{manifest} lists no haplotype")
    paths = {r["haplotype"]: readers.scan_path(spark, r["fasta"]) for r in rows}
    names = _named(spark, rows, lambda r: paths[r["haplotype"]])
    return readers.read_fasta(spark, sorted(set(paths.values())), overlap=OVERLAP).join(F.broadcast(names), "file").drop("file")


def _sidecars(spark: SparkSession, manifest: str, suffix: str, read) -> DataFrame | None:
    """What ``read`` gives of all sidecar files that exist, with their haplotype."""
    rows = readers.read_manifest(spark, manifest, check=False).collect()
    found = [(r, p) for r in rows if readers.exists(spark, p := readers.sidecar(spark, r["fasta"], suffix))]
    if not found:
        return None
    paths = {r["haplotype"]: p for r, p in found}
    names = _named(spark, [r for r, _ in found], lambda r: paths[r["haplotype"]])
    # a sidecar is a file, or a folder with files of Spark's writers
    file = F.regexp_extract("path", f"^(.*{re.escape(suffix)})(/[^/]*)?$", 1)
    return read(spark, sorted(set(paths.values()))).withColumn("file", file).join(names, "file").drop("file", "path")


def _blocks(spark: SparkSession, manifest: str, target: DataFrame | None = None) -> DataFrame | None:
    """Alignment blocks; of a run with one target only those that it overlaps."""
    row = target.select("chrom", "start", "end").first() if target is not None else None
    near = (row["chrom"], row["start"], row["end"]) if row else (None, None, None)
    return _sidecars(spark, manifest, ".chm13.paf", lambda s, paths: readers.read_paf(s, paths, *near))


def _grids(spark: SparkSession, manifest: str) -> DataFrame | None:
    return _sidecars(spark, manifest, ".anchors.tsv.gz", lambda s, paths: readers.read_grid(s, paths)[0])


def _digest(args: argparse.Namespace, *files: str) -> str:
    """Tells runs apart by all their parameters and by the contents of small files."""
    told = {k: v for k, v in vars(args).items() if k not in ("outdir", "stages", "workdir", "quarto")}
    texts = [pathlib.Path(f).read_text() for f in files if f and pathlib.Path(f).exists()]
    return hashlib.sha256(json.dumps([told, texts], sort_keys=True, default=str).encode()).hexdigest()[:16]


def _raw(args: argparse.Namespace) -> dict:
    """The configuration, with the mode of the command line."""
    raw = readers.load_config(args.config) if args.config else {}
    mode = getattr(args, "mode", None)
    return raw | {"dropout": (raw.get("dropout") or {}) | {"mode": mode}} if mode else raw


def _flank(raw: dict) -> int:
    return (raw.get("design") or {}).get("flank", 20_000)


def _target(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(target, text, bases) of coordinates on the backbone or another assembly, or of a file with one locus."""
    target = spark.createDataFrame([("target", args.target, None)], "target string, text string, bases string")
    if not re.match(r"^[^:\s]+:[\d,]+-[\d,]+$", args.target.strip()):
        if not readers.exists(spark, args.target):
            raise ValueError(f"{args.target} is neither coordinates nor a file")
        whole = readers.whole_contigs(readers.read_fasta(spark, args.target)).orderBy("contig_idx")
        return spark.createDataFrame([("target", None, "".join(r["sequence"] for r in whole.collect()))], "target string, text string, bases string")  # one locus
    if args.target_assembly == "chm13":
        return target
    if not args.grch38:
        raise ValueError("--grch38 is needed for its coordinates")
    locus = target.select("target", "text", plans.parse_locus(F.col("text")).alias("l")).select("target", "text", F.col("l.chrom").alias("q_name"), F.col("l.start").alias("lo"), F.col("l.end").alias("hi"), F.lit("+").alias("strand"))
    return project.fetch(locus, _chunks(spark, args.grch38), []).select("target", "text", "bases")


def selftest(args: argparse.Namespace) -> int:
    spark = _session()
    cells = plans.example_cells(spark).cache()
    counts = dict.fromkeys(pcr.STATUSES, 0) | {r["status"]: r["count"] for r in cells.groupBy("status").count().collect()}
    metrics = pcr.cell_summary(cells, ["pair"]).withColumn("penalty", F.lit(0.0)).withColumn("summary", reports.summary_text())
    rows = reports.collected(cells, pcr.rank(metrics), 100)
    print("statuses:", counts, "coverage:", rows[0]["coverage"])
    print("\n".join(reports.write("design", rows, args.outdir, {"target": "example"}).values()))
    return int(set(counts.values()) != {1})


def verify(args: argparse.Namespace) -> int:
    spark = _session()
    primers = readers.read_primers(spark, args.primers)
    backbone = _chunks(spark, args.backbone)
    targets = primers.select(F.col("primer_id").alias("target"), F.col("target").alias("text"), F.lit(None).cast("string").alias("bases"))
    if args.target_assembly != "chm13":
        if not args.grch38:
            raise ValueError("--grch38 is needed for its coordinates")
        other = _chunks(spark, args.grch38)
        locus = primers.select(F.col("primer_id").alias("target"), F.col("target").alias("text"), plans.parse_locus(F.col("target")).alias("l")).select("target", "text", F.col("l.chrom").alias("q_name"), F.col("l.start").alias("lo"), F.col("l.end").alias("hi"), F.lit("+").alias("strand"))
        targets = project.fetch(locus, other, []).select("target", "text", "bases")
    at = written(plans.anchored(targets, backbone).withColumnRenamed("target", "pair"), "anchored")[0]
    contigs = _contigs(spark, args.samples)
    pairs = primers.select(F.col("primer_id").alias("pair"), "forward", "reverse").join(at.select("pair", (F.col("end") - F.col("start")).alias("expected_size")), "pair")
    # the locus is widened before it is projected, so that a primer with a variant in it stays inside
    wide = plans.widened(at, project.lengths_of(backbone, []))
    loci = written(plans.projected(wide, contigs.select("haplotype").distinct(), contigs, _blocks(spark, args.samples), backbone, _grids(spark, args.samples)), "loci")[0]
    raw = readers.load_config(args.config) if args.config else {}
    config = plans.config_of(raw, args.mode)
    cells, summary = plans.verify(pairs, loci, contigs, config, args.max_amplicon, args.size_tolerance)
    cells = written(cells, "cells")[0]
    told = at.select("pair", F.format_string("%s:%d-%d", "chrom", "start", "end").alias("target_chm13")).join(primers.select(F.col("primer_id").alias("pair"), "target", "forward", "reverse"), "pair")
    rows = reports.collected(cells, summary.join(told, "pair"), config.max_sites)
    for r in pcr.console_dropouts(cells, ["pair"]).orderBy("pair").collect():
        print(f"{r['pair']}: {r['dropouts']} dropout, {r['with_off_target']} with off-target of {r['cells']}")
    print("\n".join(reports.write("verify", rows, args.outdir, {"target_assembly": args.target_assembly, "n_pairs": len(rows), "max_amplicon": args.max_amplicon}, args.quarto).values()))
    return 0


def design(args: argparse.Namespace) -> int:
    """Anchor, project, mask, pick, evaluate on windows, evaluate the shortlist everywhere, rank.

    With --stages each stage's table is kept there, in a folder for the run's parameters,
    and a later run with the same ones goes on from those it finds.
    """
    spark = _session()
    own = _digest(args, args.config, args.samples)

    def stage(name: str, df: DataFrame) -> DataFrame:
        if not args.stages:
            return written(df, name)[0]
        path = f"{args.stages}/{own}/{name}"
        if not readers.exists(spark, path + "/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    backbone = _chunks(spark, args.backbone)
    target = _target(spark, args)
    raw = _raw(args)
    flank = _flank(raw) if args.flank is None else args.flank
    at = plans.anchored(target, backbone).withColumnRenamed("target", "pair")
    wide = stage("anchor", at.select("pair", "chrom", "start", "end"))
    wide = plans.widened(wide, project.lengths_of(backbone, []), flank)
    template = stage("template", project.fetch(wide.select(F.lit("target").alias("template"), F.col("chrom").alias("q_name"), F.col("start").alias("lo"), F.col("end").alias("hi"), F.lit("+").alias("strand")), backbone, []).select("template", F.col("bases").alias("sequence")))
    contigs = stage("contigs", _contigs(spark, args.samples))
    loci = stage("project", plans.projected(wide, contigs.select("haplotype").distinct(), contigs, _blocks(spark, args.samples, wide), backbone, _grids(spark, args.samples)))
    cut = project.fetch(loci.where("chrom is not null").select("haplotype", F.col("chrom").alias("q_name"), F.col("start").alias("lo"), F.col("end").alias("hi"), "strand"), contigs, ["haplotype"], orient=True)
    windows = stage("windows", cut.select("haplotype", F.lit("window").alias("chrom"), F.lit(0).alias("contig_idx"), F.col("bases").alias("sequence")))
    alignments = stage("alignments", align.align_windows(template, windows))
    cells, ranked = plans.design_run(template, windows, contigs, loci.select("haplotype", "chrom", "start", "end"), alignments, raw, args.top_k, stage=stage)
    ranked = ranked.withColumn("summary", reports.summary_text())
    rows = reports.collected(cells, ranked, plans.config_of(raw).max_sites)
    print(f"{sum(r['passed'] for r in rows)} of {len(rows)} pairs pass")
    print("\n".join(reports.write("design", rows, args.outdir, {"target": args.target, "n_pairs": len(rows)}, args.quarto).values()))
    return 0


def _beside(spark: SparkSession, path: str, suffix: str, read, haplotype: str) -> DataFrame | None:
    """What ``read`` gives of an assembly's sidecar file, if there is one."""
    found = readers.sidecar(spark, path, suffix)
    return read(spark, found).withColumn("haplotype", F.lit(haplotype)) if readers.exists(spark, found) else None


def anchor(args: argparse.Namespace) -> int:
    spark = _session()
    found = stages.anchor(spark, _target(spark, args), _chunks(spark, args.backbone), _flank(_raw(args)))
    stages.save(found, args.out)
    print(f"anchored {found['chrom']}:{found['start']}-{found['end']}")
    return 0


def project_stage(args: argparse.Namespace) -> int:
    spark = _session()
    beside = lambda suffix, read: _beside(spark, args.fasta, suffix, read, args.haplotype)
    contigs = _chunks(spark, args.fasta).withColumn("haplotype", F.lit(args.haplotype))
    found = stages.project_one(spark, stages.load(args.anchor), args.haplotype, args.fasta, contigs, beside(".chm13.paf", readers.read_paf), beside(".anchors.tsv.gz", lambda s, p: readers.read_grid(s, p)[0]))
    stages.save(found, args.out)
    print(f"{args.haplotype}: {found['reason']}")
    return 0


def design_candidates(args: argparse.Namespace) -> int:
    made = stages.design_candidates(_session(), stages.load(args.anchor), [stages.load(p) for p in args.projection], _raw(args))
    stages.save(made, args.out)
    print(f"{len(made['excluded'])} regions masked, {len(made['candidates'])} candidates")
    return 0


def stage_a(args: argparse.Namespace) -> int:
    made = stages.stage_a(_session(), stages.load(args.candidates), [stages.load(p) for p in args.projection], _raw(args), args.top_k)
    stages.save(made, args.out)
    print(f"{len(made['candidates'])} of {len(made['stage_a_coverage'])} candidates go on")
    return 0


def evaluate(args: argparse.Namespace) -> int:
    spark = _session()
    projection = stages.load(args.projection)
    contigs = _chunks(spark, args.fasta or projection["fasta"]).withColumn("haplotype", F.lit(projection["hap_id"]))
    made = stages.evaluate_one(spark, stages.load(args.candidates), projection, contigs, _raw(args))
    stages.save(made, args.out)
    print(f"{len(made['per_pair'])} pairs on {projection['hap_id']}")
    return 0


def _report(spark: SparkSession, found: dict, candidates: dict, results: list[dict], raw: dict, args: argparse.Namespace) -> int:
    cells, ranked = stages.aggregate(spark, candidates, results, raw)
    rows = reports.collected(cells, ranked.withColumn("summary", reports.summary_text()), plans.config_of(raw).max_sites)
    print(f"{sum(r['passed'] for r in rows)} of {len(rows)} pairs pass")
    told = {"target": f"{found['chrom']}:{found['start']}-{found['end']}", "n_haplotypes": len(results), "n_pairs": len(rows)}
    print("\n".join(reports.write("design", rows, args.outdir, told, args.quarto).values()))
    return 0


def aggregate(args: argparse.Namespace) -> int:
    return _report(_session(), stages.load(args.anchor), stages.load(args.candidates), [stages.load(p) for p in args.result], _raw(args), args)


def _ready(path: str, make) -> str:
    """A step's record: made once for its parameters, which are in its path."""
    if not pathlib.Path(path).exists():
        record = make()
        stages.save(record, path + ".part")
        pathlib.Path(path + ".part").replace(path)
    return path


def workflow(args: argparse.Namespace) -> int:
    """All steps over a manifest, one after the other; a run that was cut goes on from the records that it finds."""
    spark, raw = _session(), _raw(args)
    work = pathlib.Path(args.workdir) / _digest(args, args.config, args.samples)
    work.mkdir(parents=True, exist_ok=True)
    rows = readers.read_manifest(spark, args.samples).orderBy("haplotype").collect()  # a row for each haplotype
    at = _ready(f"{work}/anchor.json", lambda: stages.anchor(spark, _target(spark, args), _chunks(spark, args.backbone), _flank(raw)))
    own = lambda r: re.sub(r"[^A-Za-z0-9_.-]", "_", r["haplotype"])
    contigs = lambda r: _chunks(spark, r["fasta"]).withColumn("haplotype", F.lit(r["haplotype"]))
    beside = lambda r, suffix, read: _beside(spark, r["fasta"], suffix, read, r["haplotype"])
    projections = [_ready(f"{work}/{own(r)}.projection.json", lambda r=r: stages.project_one(spark, stages.load(at), r["haplotype"], r["fasta"], contigs(r), beside(r, ".chm13.paf", readers.read_paf), beside(r, ".anchors.tsv.gz", lambda s, p: readers.read_grid(s, p)[0]))) for r in rows]
    placed = [stages.load(p) for p in projections]
    candidates = _ready(f"{work}/candidates.json", lambda: stages.design_candidates(spark, stages.load(at), placed, raw))
    short = _ready(f"{work}/shortlist.json", lambda: stages.stage_a(spark, stages.load(candidates), placed, raw, args.top_k))
    results = [_ready(f"{work}/{own(r)}.result.json", lambda r=r, p=p: stages.evaluate_one(spark, stages.load(short), p, contigs(r), raw)) for r, p in zip(rows, placed, strict=True)]
    return _report(spark, stages.load(at), stages.load(short), [stages.load(p) for p in results], raw, args)


def prepare(args: argparse.Namespace) -> int:
    """The anchor grid of each haplotype of a manifest that has none yet."""
    spark = _session()
    index = args.index or path_of(spark, "index")  # one for all haplotypes
    for r in readers.read_manifest(spark, args.samples).orderBy("haplotype").collect():  # a row for each haplotype
        path = readers.sidecar(spark, r["fasta"], ".anchors.tsv.gz")
        grid(argparse.Namespace(backbone=args.backbone, fasta=r["fasta"], out=path, step=args.step, probe=args.probe, least=args.least, force=args.force, index=index))
    return 0


def compare(args: argparse.Namespace) -> int:
    told = stages.differences(stages.load(args.expected), stages.load(args.found))
    print("\n".join(told) or "no difference")
    return int(bool(told))


def select(args: argparse.Namespace) -> int:
    """Chooses haplotypes, tells what they need, writes their manifest and, if asked to, fetches them."""
    spark = _session()
    index = spark.read.csv(args.index, header=True).withColumn("haplotype", F.col("haplotype").cast("int")).withColumn("line_no", F.monotonically_increasing_id())
    records = readers.join_metadata(index, spark.read.csv(args.metadata, header=True))
    if args.sample:
        chosen = readers.by_sample(records.where(F.col("sample_id").isin(args.sample)))
    elif args.all:
        chosen = readers.by_sample(records)
    elif args.per_superpop:
        chosen = readers.select_diverse(records, args.per_superpop)
    else:
        chosen = fetch.default_subset(records)
    if args.limit:
        chosen = chosen.limit(args.limit)
    path = F.concat(F.lit(args.data_dir + "/"), "sample_id", F.lit("_hap"), "haplotype", F.lit(".fa.gz"))
    optional = [F.col(c) if c in chosen.columns else F.lit(None).cast("string").alias(c) for c in ("assembly_md5", "assembly_fai")]
    rows = chosen.select("sample_id", "haplotype", "superpop", path.alias("path"), "population", "assembly", F.coalesce("genbank_accession", F.lit("")).alias("genbank"), *optional).collect()
    told = fetch.resources(len(rows), args.data_dir)
    print(f"{len(rows)} haplotypes: {told.download_gb:.1f} GB to download, {told.indexed_gb:.1f} GB prepared")
    if told.risky:
        print(f"this host may not do: {told.free_disk_gb:.1f} GB of disk free" + (f", {told.memory_gb:.1f} GB of memory" if told.memory_gb else ""))
        if args.fetch and not args.force:
            raise ValueError("too few resources; --force goes on")
    if args.fetch:
        for r in rows:  # a file for each haplotype
            fresh = fetch.download(r["assembly"], r["assembly_md5"], r["assembly_fai"], r["path"])
            print(f"{r['path']}: {'fetched' if fresh else 'valid already'}")
    head = ["sample", "hap", "superpop", "local_path", "md5", "release", "population", "source_url", "genbank"]
    sums = [fetch.md5_of(r["path"]) if args.fetch else "PENDING" for r in rows]
    with open(args.out, "w") as f:
        f.write("\t".join(head) + "\n")
        f.writelines("\t".join([r["sample_id"], str(r["haplotype"]), r["superpop"], r["path"], md5, "R2", r["population"], r["assembly"], r["genbank"]]) + "\n" for r, md5 in zip(rows, sums, strict=True))
    return 0


def grid(args: argparse.Namespace) -> int:
    """Anchors of one haplotype: probes of the backbone placed by an index of their minimizers.

    The index is kept where --index says, and used again by later runs on that backbone.
    """
    spark = _session()
    if readers.exists(spark, args.out) and not args.force:
        print(f"{args.out} is there already")
        return 0
    backbone, hap = _chunks(spark, args.backbone, max(OVERLAP, args.probe)), _chunks(spark, args.fasta)
    probes = written(project.probes(backbone.select("chrom", "base", "own", "sequence"), args.step, args.probe, args.least), "probes")[0]
    sought = probes.select(F.concat_ws(":", "chrom", "at").alias("target"), F.col("probe").alias("bases"))
    index = getattr(args, "index", None) or path_of(spark, "index")
    facts = {"step": args.step, "probe": args.probe, "least": args.least, "backbone": pathlib.Path(args.backbone).name}
    if not readers.exists(spark, f"{index}/about/_SUCCESS"):
        minimizers.write_index(sought, index, facts=facts)
    if {k: minimizers.about(spark, index).get(k) for k in facts} != facts:
        raise ValueError(f"{index} is the index of another backbone or other probes")
    placed = minimizers.indexed_projection(minimizers.read_index(spark, index), hap.select("chrom", "base", "own", "sequence"), []).where(F.col("mapq") >= project.ANCHOR_MAPQ)
    name = r"^(.*):(\d+)$"
    start = F.regexp_extract("target", name, 2).cast("long")
    anchors = placed.select(F.regexp_extract("target", name, 1).alias("t_name"), start.alias("t_start"), (start + args.probe).alias("t_end"), F.col("chrom").alias("q_contig"), F.col("start").alias("q_start"), F.col("end").alias("q_end"), "strand")
    anchors = written(anchors, "anchors")[0]
    if args.force and readers.exists(spark, args.out):
        discard(spark, [args.out])
    readers.write_grid(anchors, args.out, {"step": args.step, "probe": args.probe, "backbone": pathlib.Path(args.backbone).name})
    r = project.grid_statistics(probes, anchors).first()
    print(f"{r['n_anchors']} of {r['n_probes']} probes anchored ({r['anchored']:.1%})" + ("; under half, is this the right backbone?" if r["anchored"] < 0.5 else ""))
    return 0


def rerender(args: argparse.Namespace) -> int:
    """Computes metrics and ranks of a saved report anew from its cells, and writes all its files."""
    saved = stages.load(args.results)
    cells, metrics = stages.rehydrated(_session(), saved, readers.load_config(args.config) if args.config else None)
    cap = next((c["cap"] for p in saved["pairs"] for c in p["cells"] if c.get("cap") is not None), None)
    rows = reports.collected(cells, metrics.withColumn("summary", reports.summary_text()), cap)
    kind = "design" if rows and "passed" in rows[0] else "verify"
    print("\n".join(reports.write(kind, rows, args.outdir, saved["provenance"], args.quarto).values()))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="primeweft", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("selftest")
    c.add_argument("--outdir", default="selftest_out")
    c = sub.add_parser("verify")
    for name in ("--primers", "--backbone", "--samples"):
        c.add_argument(name, required=True)
    c.add_argument("--target-assembly", choices=["grch38", "chm13"], default="grch38")
    c.add_argument("--grch38")
    c.add_argument("--outdir", default="verify_out")
    c.add_argument("--max-amplicon", type=int, default=2000)
    c.add_argument("--size-tolerance", type=int, default=20)
    c.add_argument("--mode", choices=["thermo", "rule"])
    c.add_argument("--config")
    c.add_argument("--quarto", action="store_true")
    c = sub.add_parser("design")
    for name in ("--target", "--backbone", "--samples"):
        c.add_argument(name, required=True)
    c.add_argument("--target-assembly", choices=["grch38", "chm13"], default="chm13")
    c.add_argument("--grch38")
    c.add_argument("--outdir", default="design_out")
    c.add_argument("--stages")
    c.add_argument("--mode", choices=["thermo", "rule"])
    c.add_argument("--config")
    c.add_argument("--flank", type=int)
    c.add_argument("--top-k", type=int, default=5)
    c.add_argument("--quarto", action="store_true")
    modes = ["thermo", "rule"]
    steps = {
        "anchor": [("--target", {}), ("--backbone", {}), ("--out", {})],
        "project": [("--anchor", {}), ("--fasta", {}), ("--haplotype", {}), ("--out", {})],
        "design-candidates": [("--anchor", {}), ("--projection", {"action": "append"}), ("--out", {})],
        "stage-a": [("--candidates", {}), ("--projection", {"action": "append"}), ("--out", {})],
        "evaluate": [("--candidates", {}), ("--projection", {}), ("--out", {})],
        "aggregate": [("--anchor", {}), ("--candidates", {}), ("--result", {"action": "append"}), ("--outdir", {})],
        "compare": [("--expected", {}), ("--found", {})],
    }
    for name, options in steps.items():
        c = sub.add_parser(name)
        for option, more in options:
            c.add_argument(option, required=True, **more)
        c.add_argument("--config")
        if name in ("stage-a", "evaluate"):
            c.add_argument("--mode", choices=modes)
        if name == "anchor":
            c.add_argument("--target-assembly", choices=["grch38", "chm13"], default="chm13")
            c.add_argument("--grch38")
        if name == "stage-a":
            c.add_argument("--top-k", type=int, default=5)
        if name == "evaluate":
            c.add_argument("--fasta")
        if name == "aggregate":
            c.add_argument("--quarto", action="store_true")
    c = sub.add_parser("workflow")
    for name in ("--target", "--backbone", "--samples", "--workdir", "--outdir"):
        c.add_argument(name, required=True)
    c.add_argument("--target-assembly", choices=["grch38", "chm13"], default="chm13")
    c.add_argument("--grch38")
    c.add_argument("--mode", choices=modes)
    c.add_argument("--config")
    c.add_argument("--top-k", type=int, default=5)
    c.add_argument("--quarto", action="store_true")
    c = sub.add_parser("select")
    for name in ("--index", "--metadata", "--out"):
        c.add_argument(name, required=True)
    c.add_argument("--data-dir", default="data")
    c.add_argument("--sample", action="append")
    c.add_argument("--all", action="store_true")
    c.add_argument("--per-superpop", type=int, default=0)
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--fetch", action="store_true")
    c.add_argument("--force", action="store_true")
    for command, needed in (("grid", ("--backbone", "--fasta", "--out")), ("prepare", ("--backbone", "--samples"))):
        c = sub.add_parser(command)
        for name in needed:
            c.add_argument(name, required=True)
        for name, value in (("--step", project.STEP), ("--probe", project.PROBE), ("--least", project.MIN_CONTIG)):
            c.add_argument(name, type=int, default=value)
        c.add_argument("--force", action="store_true")
        c.add_argument("--index")
    c = sub.add_parser("rerender")
    for name in ("--results", "--outdir"):
        c.add_argument(name, required=True)
    c.add_argument("--config")
    c.add_argument("--quarto", action="store_true")
    return p


COMMANDS = {
    "selftest": selftest,
    "design": design,
    "verify": verify,
    "anchor": anchor,
    "project": project_stage,
    "design-candidates": design_candidates,
    "stage-a": stage_a,
    "evaluate": evaluate,
    "aggregate": aggregate,
    "workflow": workflow,
    "prepare": prepare,
    "select": select,
    "grid": grid,
    "rerender": rerender,
    "compare": compare,
}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return COMMANDS[args.command](args)
    except (ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
