import json
import random

import pytest
from primeweft.functions.sequences import revcomp_text
from primeweft.functions.thermo import MISMATCHES, Conditions, duplex_tm, oligo_tm, pair_tm, stacks
from primeweft.operators import pcr
from primeweft.plans import reports, verify as plans
from pyspark.sql import functions as F


@pytest.mark.parametrize("how", ["arrow", "seed_join", "expr"])
def test_one_haplotype_for_each_status(spark, how):
    cells = plans.example_cells(spark, how).cache()
    assert {r["haplotype"].split("#")[0]: r["status"] for r in cells.collect()} == {"HG_pass": "pass", "HG_drop": "dropout", "HG_off": "off_target", "HG_multi": "multi_product", "HG_unc": "uncertain"}
    s = pcr.cell_summary(cells, ["pair"]).first()
    assert (s["coverage"], s["unique_rate"], s["evaluable"]) == (0.5, 0.25, 4)
    reason = {r["haplotype"].split("#")[0]: r["reason"] for r in cells.collect()}
    assert reason["HG_pass"] == "single on-target product 140 bp" and reason["HG_multi"].endswith("products (1 on-target)")
    assert "within 3' 5nt > max 0" in reason["HG_drop"]


def test_thermo_mode_on_the_example(spark):
    pairs, contigs, loci = plans.example(spark)
    cells = pcr.evaluate(pairs, contigs, loci, pcr.Evaluation("thermo", min_product=80, max_product=200, thermo=pcr.Thermo(design_tm=55.0)))
    got = {r["haplotype"].split("#")[0]: r["status"] for r in cells.collect()}
    assert got["HG_pass"] == "pass" and got["HG_drop"] == "dropout" and got["HG_unc"] == "uncertain"
    with pytest.raises(ValueError):
        pcr.evaluate(pairs, contigs, loci, pcr.Evaluation("other"))


def test_sites_are_judged_by_their_own_pair(spark):
    weak, strong = ("ATTTAGCTATTAGCATTACA", "TGTTATCATTTCATTAGTCA"), ("GCGCCGACCGTGGCACTGCC", "CCGGACGCTCGAGGCGCACG")
    tms = [r[0] for r in spark.createDataFrame([weak, strong], "f string, r string").select(pair_tm(F.col("f"), F.col("r"))).collect()]
    assert tms[0] < 50 and tms[1] > 66
    other = {"A": "C", "C": "A", "G": "T", "T": "G"}
    rows = []
    for h, changed in (("same", False), ("changed", True)):
        for i, (f, r) in enumerate((weak, strong)):
            site = f[:5] + other[f[5]] + f[6:11] + other[f[11]] + f[12:] if changed else f
            rows.append((h, f"c{i}", i, "A" * 30 + site + "GATTACA" * 20 + revcomp_text(r) + "A" * 30))
    contigs = spark.createDataFrame(rows, "haplotype string, chrom string, contig_idx int, sequence string")
    pairs = spark.createDataFrame([("weak", *weak), ("strong", *strong)], "pair string, forward string, reverse string")
    loci = spark.createDataFrame([(p, h, f"c{i}", 0, 1000) for h in ("same", "changed") for i, p in enumerate(("weak", "strong"))], "pair string, haplotype string, chrom string, start long, end long")
    got = {(x["pair"], x["haplotype"]): x for x in pcr.evaluate(pairs, contigs, loci).collect()}
    # a perfect pair passes whatever its temperature, which a fixed one of 60 would call a dropout
    assert got["weak", "same"]["status"] == got["strong", "same"]["status"] == "pass"
    assert got["weak", "changed"]["status"] == got["strong", "changed"]["status"] == "dropout"
    threshold = {p: f"{round(t - 5, 1):.1f}C" for p, t in zip(("weak", "strong"), tms, strict=True)}
    assert all(threshold[p] in got[p, "changed"]["reason"] and "annealing Tm" in got[p, "changed"]["reason"] for p in threshold)
    fixed = pcr.evaluate(pairs, contigs, loci, pcr.Evaluation(thermo=pcr.Thermo(design_tm=60.0))).where("pair = 'weak' and haplotype = 'same'").first()
    assert fixed["status"] == "dropout" and "< 55.0C" in fixed["reason"]


def test_mismatch_stacks(spark):
    table = stacks()
    assert len(table) == 16 + len(MISMATCHES | {k[::-1]: 0 for k in MISMATCHES})
    assert table["CG/GC"] == (106, 272) and table["AG/TT"] == table["TT/GA"] == (-10, -9)
    c = Conditions()
    rows = [("GCGCATTACGGCATCGACTG", w) for w in ("GCGCATTACGGCATCGACTG", "GCGCATTACCGCATCGACTG", "TCGCATTACGGCATCGACTG", "GCGCATTACGGCATCGACTC", "TTTTTTTTTTTTTTTTTTTT")]
    got = [r[0:2] for r in spark.createDataFrame(rows, "p string, w string").select(duplex_tm(F.col("p"), F.col("w"), c), duplex_tm(F.col("p"), F.col("w"), c, end=True)).collect()]
    full, inner, first, last, none = got
    assert full[0] > inner[0] + 3 and full[0] > first[0] > inner[0]
    assert full[1] >= full[0] and last[1] == none[1] == -273.0 and last[0] > 40
    # without its first base the duplex is that of the shorter primer
    short = spark.createDataFrame([("CGCATTACGGCATCGACTG",)], "p string").select(duplex_tm(F.col("p"), F.col("p"), c)).first()[0]
    assert abs(first[0] - short) < 1e-9


@pytest.mark.parametrize(("cap", "status"), [(3, "dropout"), (2, "multi_product"), (0, "dropout"), (None, "dropout")])
def test_site_cap_counts_competent_sites(spark, cap, status):
    p = plans.FORWARD
    contigs = spark.createDataFrame([("h", "c", 0, ("T" * 30).join([p] * 3))], "haplotype string, chrom string, contig_idx int, sequence string")
    pairs = spark.createDataFrame([("x", p, "G" * 20)], "pair string, forward string, reverse string")
    loci = spark.createDataFrame([("x", "h", "c", 0, 99)], "pair string, haplotype string, chrom string, start long, end long")
    r = pcr.evaluate(pairs, contigs, loci, pcr.Evaluation("rule", max_sites=cap)).first()
    assert r["status"] == status and r["n_products"] == 0
    if cap == 2:
        assert r["reason"] == ">2 binding sites (forward primer); likely repeat-derived"


def test_amplicons_equal_all_pairs(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice("+-"), (at := r.randint(0, 2000)), at + 20, r.choice("FR")) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, strand string, start long, end long, role string")
    want = sorted((p[0], p[2], m[3]) for p in rows for m in rows if p[0] == m[0] and p[1] == "+" and m[1] == "-" and p[2] <= m[2] and 60 <= m[3] - p[2] <= 250)
    got = pcr.amplicons(df, ["k"], 60, 250).collect()
    assert sorted((x["k"], x["start"], x["end"]) for x in got) == want


def test_oligo_temperatures(spark):
    seqs = ["CGCTTCATGCTGCACATCTC", "CCAAGTTGCGCAAGGTGGAG", "A"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in seqs], "s string").select(oligo_tm(F.col("s"))).collect()]
    assert got[2] is None and abs(got[1] - 62.10) < 0.05
    c = Conditions()
    both = spark.createDataFrame([(seqs[0], seqs[0]), (seqs[0], seqs[0][:10] + "A" + seqs[0][11:]), (seqs[0], None)], "p string, w string").select(duplex_tm(F.col("p"), F.col("w"), c), oligo_tm(F.col("p")), duplex_tm(F.col("p"), F.col("w"), c, end=True)).collect()
    assert abs(both[0][0] - both[0][1]) < 1e-9  # a perfect duplex is the oligo's own temperature
    assert both[1][0] < both[0][0] - 3


def test_ranking_order_and_reasons(spark):
    rows = [("b", 10, 9.0, 0, 0, 0.9, 0.9, 1.0), ("a", 10, 9.0, 0, 0, 1.0, 1.0, 2.0), ("c", 0, 0.0, 0, 3, 0.0, 0.0, 0.0), ("d", 10, 9.0, 0, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pair string, evaluable long, x double, n_off_target long, n_multi_product long, coverage double, unique_rate double, penalty double").withColumn("n_uncertain", F.lit(2)).withColumn("n_dropout", F.lit(1))
    got = pcr.rank(df).orderBy("rank").collect()
    assert [r["pair"] for r in got] == ["d", "a", "b", "c"]
    assert got[2]["reject_reasons"] == ["coverage 90.00% < 95.00% (1 dropout)"]
    assert got[3]["reject_reasons"] == ["only 0 evaluable haplotypes (< 1); 2 uncertain", "coverage 0.00% < 95.00% (1 dropout)", "3 multi-product haplotypes > 0"]
    assert [r["pair"] for r in pcr.shortlist(df.withColumn("candidate_idx", F.lit(0)), 1).collect()] == ["d"]


def test_reports(spark, tmp_path):
    cells = plans.example_cells(spark).cache()
    metrics = pcr.cell_summary(cells, ["pair"]).withColumn("penalty", F.lit(1.0)).withColumn("summary", reports.summary_text())
    rows = reports.collected(cells, pcr.rank(metrics), 100)
    for kind in ("design", "verify"):
        paths = reports.write(kind, rows, str(tmp_path / kind), {"target": "chr1:1-2"})
        assert json.load(open(paths["json"]))["pairs"][0]["evaluable"] == 4
        assert all((tmp_path / kind).joinpath(p.rsplit("/", 1)[1]).stat().st_size for p in paths.values())
    assert rows[0]["summary"] == "50% (2/4) · 1 dropout · 1 off-target · 1 multi · 1 not projectable"
    text = reports.verify_tsv(rows).split("\n")[1].split("\t")
    assert sorted(text[-5:]) == sorted(["dropout", "140 | off:140", "off:140", "140", "?"])


def test_temperatures_just_below_zero_keep_their_sign(spark):
    rows = [("A" * 20, "C" * 20, d) for d in (4.98, 5.0, 5.02, 4.94)]
    sites = spark.createDataFrame([(q, w, "+", [19], d) for q, w, d in rows], "query string, window string, strand string, offsets_3p array<int>, design_tm double")
    told = {r["design_tm"]: r["reason"] for r in pcr.thermo_reason(sites, pcr.Thermo()).collect()}
    assert told == {d: f"annealing Tm -273.0C < {d - 5:.1f}C" for _, _, d in rows}
