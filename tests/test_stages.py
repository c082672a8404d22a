import hashlib
import json
import random

import pytest
from primeweft import cli
from primeweft.functions.sequences import revcomp_text
from primeweft.operators import design
from primeweft.plans import stages
from primeweft.sources import fetch
from pyspark.sql import functions as F


@pytest.fixture
def genome(tmp_path):
    """A backbone and three haplotypes: the same, one with variants, one without the region."""
    r = random.Random(17)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    region = dna(6000)
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    changed = "".join(other[c] if 2000 < i < 4000 and i % 97 == 0 else c for i, c in enumerate(region))
    (tmp_path / "bb.fa").write_text(">chr1\n" + dna(500) + region + dna(300) + "\n")
    texts = {1: dna(900) + region, 2: dna(40) + changed + dna(50), 3: dna(5000)}
    for h, text in texts.items():
        (tmp_path / f"h_hap{h}.fa").write_text(">x\n" + text + "\n")
    (tmp_path / "s.tsv").write_text("".join(f"h\t{h}\tAFR\t{tmp_path}/h_hap{h}.fa\n" for h in texts))
    return tmp_path


def test_steps_lead_to_the_whole_run(spark, genome, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    at = lambda name: f"{genome}/{name}"
    (genome / "c.yaml").write_text("design:\n  flank: 100\n")
    run = lambda *args: cli.main([str(x) for x in args])
    assert run("anchor", "--target", "chr1:2,800-3,400", "--backbone", at("bb.fa"), "--config", at("c.yaml"), "--out", at("anchor.json")) == 0
    anchor = json.load(open(at("anchor.json")))
    assert (anchor["start"], anchor["end"], anchor["tstart"], anchor["tend"], len(anchor["template"])) == (2800, 3400, 2700, 3500, 800)
    for h in (1, 2, 3):
        assert run("project", "--anchor", at("anchor.json"), "--fasta", at(f"h_hap{h}.fa"), "--haplotype", f"h#hap{h}", "--out", at(f"p{h}.json")) == 0
    places = [json.load(open(at(f"p{h}.json"))) for h in (1, 2, 3)]
    assert [p["reason"] for p in places] == ["ok", "ok", "target did not map confidently to this haplotype"]
    assert abs(places[0]["locus"]["start"] - (900 + 2200)) < 40 and places[2]["locus"] is None
    projections = [x for h in (1, 2, 3) for x in ("--projection", at(f"p{h}.json"))]
    assert run("design-candidates", "--anchor", at("anchor.json"), *projections, "--out", at("cands.json")) == 0
    made = json.load(open(at("cands.json")))
    assert made["excluded"] and 5 < len(made["candidates"]) <= 20 and made["candidates"][0]["pair"]["name"] == "chr1_2800_pair0"
    assert run("stage-a", "--candidates", at("cands.json"), *projections, "--mode", "rule", "--top-k", 3, "--out", at("short.json")) == 0
    short = json.load(open(at("short.json")))
    assert len(short["candidates"]) == 3 and set(short["stage_a_coverage"]) == {c["pair"]["name"] for c in made["candidates"]}
    for h in (1, 2, 3):
        assert run("evaluate", "--candidates", at("short.json"), "--projection", at(f"p{h}.json"), "--mode", "rule", "--out", at(f"r{h}.json")) == 0
    first = json.load(open(at("r1.json")))["per_pair"]
    assert all(c["status"] == "pass" and c["amplicons"][0]["on_target"] for c in first.values())
    assert {c["status"] for c in json.load(open(at("r3.json")))["per_pair"].values()} == {"uncertain"}
    results = [x for h in (1, 2, 3) for x in ("--result", at(f"r{h}.json"))]
    assert run("aggregate", "--anchor", at("anchor.json"), "--candidates", at("short.json"), *results, "--outdir", at("steps")) == 0

    assert run("design", "--target", "chr1:2800-3400", "--backbone", at("bb.fa"), "--samples", at("s.tsv"), "--mode", "rule", "--flank", 100, "--top-k", 3, "--outdir", at("whole")) == 0
    steps, whole = (json.load(open(f"{genome}/{d}/results.json"))["pairs"] for d in ("steps", "whole"))
    key = lambda p: (p["forward"], p["reverse"], p["passed"], p["coverage"], [(c["haplotype"], c["status"], c["on_sizes"]) for c in p["cells"]])
    assert [key(p) for p in steps] == [key(p) for p in whole]

    # all steps by one command, which goes on from what it finds
    flow = ("workflow", "--target", "chr1:2800-3400", "--backbone", at("bb.fa"), "--samples", at("s.tsv"), "--mode", "rule", "--config", at("c.yaml"), "--top-k", 3, "--workdir", at("work"), "--outdir", at("flow"))
    assert run(*flow) == 0
    assert [key(p) for p in json.load(open(at("flow/results.json")))["pairs"]] == [key(p) for p in steps]
    records = {p.name: p.stat().st_mtime_ns for p in (genome / "work").rglob("*.json")}
    assert len(records) == 9
    next((genome / "work").rglob("h_hap2.result.json")).unlink()
    assert run(*flow) == 0
    again = {p.name: p.stat().st_mtime_ns for p in (genome / "work").rglob("*.json")}
    assert {n for n in again if again[n] != records[n]} == {"h_hap2.result.json"}
    assert "coverage" in open(at("flow/results.md")).read()

    # a saved report is computed anew from its cells
    saved = json.load(open(at("whole/results.json")))
    for c in saved["pairs"][0]["cells"]:
        c.update(status="dropout", on_sizes=[], n_on=0, n_products=0)
    (genome / "edited.json").write_text(json.dumps(saved))
    assert run("rerender", "--results", at("edited.json"), "--outdir", at("again")) == 0
    again = {p["pair"]: p for p in json.load(open(at("again/results.json")))["pairs"]}
    name = saved["pairs"][0]["pair"]
    assert again[name]["coverage"] == 0 and not again[name]["passed"] and again[name]["rank"] == 3 and "coverage" in again[name]["reject_reasons"][0]
    assert run("compare", "--expected", at("whole/results.json"), "--found", at("whole/results.json")) == 0
    assert run("compare", "--expected", at("whole/results.json"), "--found", at("again/results.json")) == 1


def test_prepare_makes_each_grid_once(spark, genome, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    args = ["prepare", "--backbone", f"{genome}/bb.fa", "--samples", f"{genome}/s.tsv", "--step", "500", "--probe", "200", "--least", "1000"]
    assert cli.main(args) == 0 and capsys.readouterr().out.count("probes anchored") == 3
    assert cli.main(args) == 0 and capsys.readouterr().out.count("is there already") == 3


def test_differences_are_told():
    cell = {"haplotype": "a", "status": "pass", "on_sizes": [5], "off_sizes": [], "size_flag": False, "capped": False, "reason": "x"}
    one = {"pairs": [{"pair": "p", "forward": "A", "cells": [cell]}, {"pair": "q", "cells": []}]}
    two = {"pairs": [{"pair": "p", "forward": "C", "cells": [cell | {"on_sizes": [6], "reason": "y"}, cell | {"haplotype": "b"}]}]}
    assert stages.differences(one, one) == []
    assert stages.differences(one, two) == ["pair q is missing", "pair p: forward is 'C', not 'A'", "pair p: haplotype b is new", "pair p, haplotype a: on_sizes is [6], not [5]"]


def test_bad_targets(spark, genome, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    common = ["--backbone", f"{genome}/bb.fa", "--out", f"{genome}/a.json"]
    for target in ("chr1:900-200", "chr9:1-2", "nothing.fa"):
        assert cli.main(["anchor", "--target", target, *common]) == 2


def test_a_subset_is_sized_and_fetched(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    rows = []
    for sample in (*fetch.DEFAULT_SAMPLES, "HG9"):
        for h in (1, 2):
            text = f"{sample} {h}".encode()
            name = f"{tmp_path}/remote_{sample}_{h}"
            open(name, "wb").write(text)
            open(name + ".md5", "w").write(hashlib.md5(text).hexdigest() + "  file\n")
            open(name + ".fai", "w").write("index\n")
            rows.append(f"{sample},{h},file://{name},file://{name}.md5,file://{name}.fai,GCA_{sample}")
    (tmp_path / "index.csv").write_text("sample_id,haplotype,assembly,assembly_md5,assembly_fai,genbank_accession\n" + "\n".join(rows) + "\n")
    (tmp_path / "meta.csv").write_text("sample_id,population_abbreviation\nHG01884,ACB\nHG9,CEU\n")
    args = ["select", "--index", f"{tmp_path}/index.csv", "--metadata", f"{tmp_path}/meta.csv", "--out", f"{tmp_path}/s.tsv", "--data-dir", f"{tmp_path}/data"]
    assert cli.main(args) == 0
    lines = [x.split("\t") for x in (tmp_path / "s.tsv").read_text().splitlines()]
    assert [(x[0], x[1], x[4]) for x in lines[1:]] == [(s, "1", "PENDING") for s in sorted(fetch.DEFAULT_SAMPLES)]
    assert "3.0 GB to download" in capsys.readouterr().out
    assert cli.main([*args, "--fetch", "--force"]) == 0 and capsys.readouterr().out.count("fetched") == 3
    lines = [x.split("\t") for x in (tmp_path / "s.tsv").read_text().splitlines()]
    assert all(fetch.md5_of(x[3]) == x[4] for x in lines[1:])
    assert cli.main([*args, "--fetch", "--force"]) == 0 and capsys.readouterr().out.count("valid already") == 3
    (tmp_path / "remote_HG01884_1.md5").write_text("0" * 32)
    assert cli.main([*args, "--fetch", "--force"]) == 2 and not (tmp_path / "data" / "HG01884_hap1.fa.gz").exists()


def test_resources():
    assert fetch.Resources(10, 100.0, None).risky is False
    assert fetch.Resources(101, 100.0, None).risky and not fetch.Resources(101, 100.0, None).disk_ok
    assert fetch.Resources(1, 100.0, 14.9).risky and not fetch.Resources(1, 100.0, 15.0).risky
    assert fetch.resources(2, "/nowhere/at/all").free_disk_gb > 0


def test_oligo_filters(spark):
    d = design.Design()
    rows = {
        "ACGTTGCAGGATCTTACCTG": True,
        "ATATTAATAATTATATAATA": False,  # too little GC
        "GCGCCGCGGCCGCGGCGGCC": False,  # too much
        "ACGTTAAAAAAGGATCTCCT": False,  # six A
        "TTAGGCCTAAGGTTACCATG": False,  # pairs with itself
        "GGCATTGCAAAACTGCAATG": False,  # a hairpin
    }
    got = {r["s"]: r["ok"] for r in spark.createDataFrame([(s,) for s in rows], "s string").select("s", design.is_usable(F.col("s"), d).alias("ok")).collect()}

    def brute(s):
        runs = lambda x, n: {x[i : i + n] for i in range(len(x) - n + 1)}
        gc = 100 * sum(c in "GC" for c in s) / len(s)
        poly = any(c * 6 in s for c in "ACGT")
        other = revcomp_text(s)
        hairpin = any(revcomp_text(s[i : i + 6]) in s[i + 9 :] for i in range(len(s) - 14))
        return 20 <= gc <= 80 and not poly and not runs(s, 8) & runs(other, 8) and s[-6:] not in other and not hairpin

    assert got == rows == {s: brute(s) for s in rows}
    r = random.Random(2)
    many = ["".join(r.choice("ACGT") for _ in range(r.randint(18, 27))) for _ in range(500)]
    got = {x["s"]: x["ok"] for x in spark.createDataFrame([(s,) for s in many], "s string").select("s", design.is_usable(F.col("s"), d).alias("ok")).collect()}
    assert got == {s: brute(s) for s in many}
