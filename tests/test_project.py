import random
import re
from collections import Counter

import pytest
from primeweft.functions.sequences import revcomp_text
from primeweft.operators import design, mask, project
from pyspark.sql import functions as F

BLOCK = "line_no long, q_name string, q_start long, q_end long, strand string, t_name string, t_start long, t_end long, cigar string"


def lift(spark, start, end, *blocks):
    t = spark.createDataFrame([("x", "chr1", start, end)], "k string, chrom string, start long, end long")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(blocks)], BLOCK)
    r = project.project_blocks(t, b, ["k"]).collect()
    return (r[0]["lo"], r[0]["hi"]) if r else None


def test_lifts_with_exact_answers(spark):
    plus, minus = ("q", 500, 700, "+", "chr1", 200, 400, None), ("q", 500, 700, "-", "chr1", 200, 400, None)
    assert lift(spark, 250, 300, plus) == (550, 600)
    assert lift(spark, 250, 300, minus) == (600, 650)
    indel = ("q", 300, 550, "+", "chr1", 200, 400, "100M50I100M")
    assert lift(spark, 300, 310, indel) == (450, 460)
    assert lift(spark, 900, 910, plus) is None
    assert lift(spark, 250, 300, ("far", 0, 10, "+", "chr1", 240, 260, None), plus) == (550, 600)


def test_cigar_walk_equals_a_table_of_bases(spark):
    r = random.Random(2)
    blocks, want = [], []
    for i in range(40):
        ops = [(r.randint(1, 9), "M")] + [(r.randint(1, 9), r.choice("M=XDIN")) for _ in range(6)] + [(3, "M")]
        t_len, q_len = sum(n for n, o in ops if o in "M=XDN"), sum(n for n, o in ops if o in "M=XI")
        strand, at = r.choice("+-"), r.randrange(t_len)
        t, q = 0, 0 if strand == "+" else q_len
        found = None
        for n, o in ops:
            for _ in range(n):
                if o in "M=XDN":
                    if t == at and found is None:
                        found = q if strand == "+" else q - 1
                    t += 1
                if o in "M=XI":
                    q += 1 if strand == "+" else -1
        want.append(found)
        blocks.append((i, 0, q_len, strand, 0, at, "".join(f"{n}{o}" for n, o in ops)))
    df = spark.createDataFrame(blocks, "i int, q_start long, q_end long, strand string, t_start long, at long, cigar string")
    c = F.col
    got = df.select("i", project.lift_cigar(c("at"), c("t_start"), c("q_start"), c("q_end"), c("strand"), project.cigar_ops(c("cigar"))).alias("q")).orderBy("i").collect()
    assert [x["q"] for x in got] == want


def _walk(ops, t_start, q_start, q_end, strand, t):
    """The lift of one place, base by base."""
    at, q = t_start, q_start if strand == "+" else q_end
    step = 1 if strand == "+" else -1
    for n, o in ops:
        for _ in range(n):
            if o in "M=XDN" and at == t:
                return q if strand == "+" else q - 1
            at += o in "M=XDN"
            q += step * (o in "M=XI")
    return q


def test_long_blocks_are_lifted_stretch_by_stretch(spark):
    r = random.Random(31)
    blocks, ops_of = [], {}
    for i in range(6):
        ops = [(r.randint(1, 900), "M")] + [(r.randint(1, 900), r.choice("M=XMM")) if j % 2 else (r.randint(1, 90), r.choice("DINSHP")) for j in range(r.choice([1, 30, 400]))]
        t_len, q_len = sum(n for n, o in ops if o in "M=XDN"), sum(n for n, o in ops if o in "M=XI")
        start, strand = r.randrange(10**6), r.choice("+-")
        # cigars that end before the block does, and after
        blocks.append((i, f"q{i}", 5000, 5000 + q_len, strand, f"chr{i % 2}", start, start + t_len + r.choice([0, 0, 7, -5]), "".join(f"{n}{o}" for n, o in ops)))
        ops_of[i] = ops
    blocks += [(7, "junk", 10, 90, "-", "chr3", 100, 180, "*"), (8, "none", 10, 90, "+", "chr4", 100, 180, None), (9, "empty", 10, 90, "+", "chr5", 100, 180, "")]
    # a second block of the same extent, on a later line, and the same one once more
    blocks += [(20, "later", 0, 9, "+", *blocks[0][5:8], "5M"), blocks[1]]
    targets = [("at", "chr3", 120, 130), ("mid", "chr4", 120, 130), ("e", "chr5", 150, 900), ("nothing", "chr9", 1, 2), (None, "chr4", 1, 140), ("null", None, 1, 2), ("open", "chr4", None, 140)]
    for i, b in enumerate(blocks[:6]):
        targets += [(f"{i}-{j}", b[5], *sorted(r.randrange(b[6] - 50, b[7] + 50) for _ in range(2))) for j in range(25)]
        targets += [(f"{i}-whole", b[5], b[6], b[7]), (f"{i}-around", b[5], 0, 10**9)]
    t = spark.createDataFrame(targets + targets[:3], "k string, chrom string, start long, end long")
    want = {}
    for k, chrom, start, end in targets:
        if start is None:
            continue
        found = [(min(end, b[7]) - max(start, b[6]), -b[0], n) for n, b in enumerate(blocks) if b[5] == chrom and start < b[7] and b[6] < end]
        if found:
            b = blocks[max(found)[2]]
            places = max(start, b[6]), min(end, b[7])
            if b[8]:
                lifted = [_walk(ops_of.get(b[0], []), b[6], b[2], b[3], b[4], x) for x in places]
            else:
                lifted = [x - 90 for x in places]
            want[k, chrom] = (b[1], min(lifted), max(lifted), b[4])
    frame = spark.createDataFrame(blocks, BLOCK)
    for n in (1, 5, 256):
        got = project.project_blocks(t, frame, ["k"], n).collect()
        assert len(got) == len(want) and {(x["k"], x["chrom"]): (x["q_name"], x["lo"], x["hi"], x["strand"]) for x in got} == want


def test_operations_are_cut_with_running_sums(spark):
    rows = [(1, 100, 1000, 0, 60, "+", "10M5I10D20M3S"), (2, 100, 1000, 0, 60, "-", "10M5I10D20M"), (3, 0, 9, 0, 9, "+", "x9"), (4, 0, 9, 0, 9, "+", None), (5, 0, 9, 0, 9, "+", "4Q12=I3")]
    b = spark.createDataFrame(rows, "line_no long, t_start long, t_end long, q_start long, q_end long, strand string, cigar string")
    got = {}
    for x in project.cigar_stretches(b, 2).orderBy("line_no", "t_from").collect():
        got.setdefault(x["line_no"], []).append((x["t_from"], x["t_upto"], x["q_at"], x["ops"], x["last"]))
    assert got[1] == [(100, 110, 0, "10M5I", False), (110, 140, 15, "10D20M", False), (140, 140, 35, "3S", True)]
    assert got[2] == [(100, 110, 60, "10M5I", False), (110, 140, 45, "10D20M", True)]
    assert got[3] == [(0, 0, 0, "", True)] and got[5] == [(0, 12, 0, "12=", True)] and 4 not in got


def test_bytes_moved_for_a_lift_do_not_grow_with_its_block(spark):
    for n in (200, 40_000):
        b = spark.createDataFrame([(1, "q", 0, 901 * n, "+", "chr1", 0, 900 * n, "900M1I" * n)], BLOCK)
        t = spark.createDataFrame([("x", "chr1", 450 * n, 450 * n + 40)], "k string, chrom string, start long, end long")
        df = project.project_blocks(t, b, ["k"])
        assert [x["lo"] for x in df.collect()] == [450 * n + n // 2]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan
        final = plan[: plan.find("== Initial Plan ==")]
        # the cigars' side is joined where it is: no exchange lies below the step that cuts them but that of the places sent to it
        below = final[final.index("MapInArrow") :]
        assert "LeftSemi" in below and "BroadcastExchange" in below and "hashpartitioning" not in below


def test_anchor_windows(spark):
    t = spark.createDataFrame([("x", "chr1", 100_000, 101_000)], "k string, chrom string, start long, end long")
    rows = [("chr1", 90_000 + 10_000 * i, "good", 500_000 + 10_000 * i, 501_000 + 10_000 * i) for i in range(5)] + [("chr1", 95_000, "bad", 1, 1001), ("chr1", 96_000, "good", 9_000_000, 9_001_000), ("chr2", 100_000, "no", 1, 2)]
    a = spark.createDataFrame(rows, "t_name string, t_start long, q_contig string, q_start long, q_end long")
    r = project.anchor_windows(t, a, ["k"]).first()
    assert (r["contig"], r["lo"], r["hi"], r["n_anchors"], r["reason"]) == ("good", 480_000, 561_000, 5, None)
    assert project.anchor_windows(t, a.where("t_name = 'chr2'"), ["k"]).count() == 0


def test_kmer_projection_finds_planted_places(spark):
    r = random.Random(3)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    target = dna(400)
    changed = "".join(c if r.random() > 0.02 else r.choice("ACGT") for c in target)
    twice = dna(300)
    contigs = spark.createDataFrame([("a", dna(5000) + changed + dna(3000)), ("b", dna(2000) + revcomp_text(dna(100))), ("c", dna(500) + twice + dna(700) + twice)], "chrom string, sequence string")
    targets = spark.createDataFrame([("t", target), ("rc", revcomp_text(target)), ("none", dna(400)), ("two", twice)], "target string, bases string")
    got = {x["target"]: x for x in project.kmer_projection(targets, contigs, []).collect()}
    assert set(got) == {"t", "rc", "two"}
    assert got["t"]["chrom"] == "a" and abs(got["t"]["start"] - 5000) < 60 and abs(got["t"]["end"] - 5400) < 60 and got["t"]["strand"] == "+"
    assert got["rc"]["strand"] == "-" and abs(got["rc"]["start"] - 5000) < 60
    assert got["two"]["ambiguous"] and not got["t"]["ambiguous"]
    assert got["two"]["mapq"] == 0 and got["t"]["mapq"] == 60


def test_both_ways_to_look_up_targets_agree(spark, monkeypatch):
    r = random.Random(13)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    shared, rows = dna(150), []
    for h in ("a", "b"):
        for i in range(4):
            text = list(dna(600) + shared + dna(200) + revcomp_text(shared) + dna(100))
            for _ in range(20):
                text[r.randrange(len(text))] = r.choice("ACGTNacgt")
            rows.append((h, f"c{i}", "".join(text)))
    rows += [("b", "short", "ACGT"), ("b", "none", None)]
    contigs = spark.createDataFrame(rows, "haplotype string, chrom string, sequence string")
    targets = spark.createDataFrame([(h, t, s) for h in ("a", "b", "c") for t, s in (("s", shared), ("low", shared.lower()), ("n", "N" * 40), ("part", shared[20:120]))], "haplotype string, target string, bases string")
    get = lambda: sorted(map(str, project.kmer_projection(targets, contigs, ["haplotype"]).collect()))
    found = get()
    monkeypatch.setattr(project, "SENT", 0)
    assert found == get() and len(found) == 6


@pytest.mark.parametrize("sent", [project.SENT, 0])
def test_kmer_projection_of_a_target_with_many_copies(spark, monkeypatch, sent):
    monkeypatch.setattr(project, "SENT", sent)
    monkeypatch.setattr(project, "CROWD", 16)
    r = random.Random(5)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    target, end = dna(200), dna(60)
    rows = [("c%03d" % i, dna(30) + target + dna(20)) for i in range(90)] + [("e%03d" % i, dna(40) + end) for i in range(90)]
    once = end + dna(140) + end  # its ends are frequent
    rows.append(("once", dna(2000) + once + dna(10)))
    targets = spark.createDataFrame([("many", target), ("once", once)], "target string, bases string")
    got = {x["target"]: x.asDict() for x in project.kmer_projection(targets, spark.createDataFrame(rows, "chrom string, sequence string"), []).collect()}
    assert got["many"] == {"target": "many", "chrom": "c000", "start": 30, "end": 230, "strand": "+", "span": 200, "votes": 186, "runner_up": 200, "rivals": [], "ambiguous": True, "mapq": 0}
    assert (got["once"]["chrom"], got["once"]["start"], got["once"]["end"], got["once"]["votes"]) == ("once", 2000, 2260, 246)


def test_masks(spark):
    p = lambda x: spark.createDataFrame([("t", i) for i in x], "template string, pos long")
    get = lambda df: sorted((x["start"], x["length"]) for x in df.collect())
    assert get(mask.islands(p([0, 1, 5, 100, 5]), ["template"], 0)) == [(0, 2), (5, 1), (100, 1)]
    assert get(mask.islands(p([0, 1, 5, 100]), ["template"], 3)) == [(0, 6), (100, 1)]
    many = p(range(0, 5000, 10))
    assert get(mask.islands(many, ["template"], 25)) == [(0, 4991)]
    assert len(get(mask.widest(mask.islands(many, ["template"]), ["template"]))) == 200
    a = spark.createDataFrame([("t", 2, ":3*ac-gg:1+tt=AC"), ("t", 5, "*ga:4")], "template string, r_start long, cs string")
    got = {x["pos"]: x["n_variants"] for x in mask.pileup(mask.variants(a, F.lit(9))).collect()}
    assert got == {5: 2, 6: 1, 7: 1}


def test_variants_equal_a_plain_walk(spark):
    r = random.Random(21)
    made = lambda: "".join(r.choice([f":{r.randrange(1, 6)}", "*ac", f"-{'acg'[: r.randrange(1, 4)]}", f"+{'tt'[: r.randrange(1, 3)]}", "=ACGT"]) for _ in range(r.randrange(0, 8)))
    rows = [(f"t{r.randrange(3)}", r.randrange(-4, 20), made(), r.randrange(8, 24)) for _ in range(300)]
    want = Counter()
    for template, at, cs, n in rows:
        for op, text in re.findall(r"([:*+=-])(\w+)", cs):
            span = int(text) if op == ":" else 1 if op == "*" else 0 if op == "+" else len(text)
            want.update((template, p) for p in ([at] if op in "*+" else range(at, at + span) if op == "-" else []) if 0 <= p < n)
            at += span
    rows += [("t0", 3, None, 9), ("t0", None, "*ac", 9), ("t0", 3, "*ac", None), ("none", 3, ":4", 9), (None, 3, "*ac", 9)]
    want[None, 3] += 1
    a = spark.createDataFrame(rows, "template string, r_start long, cs string, n long")
    assert {(x["template"], x["pos"]): x["n_variants"] for x in mask.pileup(mask.variants(a, F.col("n"))).collect()} == dict(want)


def test_a_task_counts_its_own_templates(spark):
    a = spark.range(0, 4000, 1, 8).select((F.col("id") % 100).alias("template"), (F.col("id") % 70).alias("r_start"), F.lit(":2*ac-gg").alias("cs"))
    where = mask.variants(a, F.lit(90)).select("template", F.spark_partition_id().alias("part")).distinct()
    assert where.count() == 100


def test_candidates_equal_a_direct_search(spark):
    r = random.Random(7)
    text = "".join(r.choice("ACGT") for _ in range(260))
    d = design.Design(product_min=80, product_max=200, n_candidates=15)
    x = spark.createDataFrame([("t", 100, 20)], "template string, start long, length long")
    got = design.candidates(spark.createDataFrame([("t", text)], "template string, sequence string"), x, d).orderBy("candidate_idx").collect()
    from primeweft.functions.thermo import oligo_tm

    windows = [(i, n) for i in range(len(text)) for n in range(18, 28) if i + n <= len(text)]
    tms = spark.createDataFrame([(text[i : i + n],) for i, n in windows], "s string").select(oligo_tm(F.col("s"))).collect()
    ok = [(i, n, round(abs(tm[0] - 60) + abs(n - 20), 6)) for (i, n), tm in zip(windows, tms, strict=True) if 57 <= tm[0] <= 63 and (i + n <= 100 or i >= 120)]
    runs = lambda x, n: {x[i : i + n] for i in range(len(x) - n + 1)}

    def usable(s):
        other = revcomp_text(s)
        return 20 <= 100 * sum(c in "GC" for c in s) / len(s) <= 80 and not any(c * 6 in s for c in "ACGT") and not runs(s, 8) & runs(other, 8) and s[-6:] not in other and not any(revcomp_text(s[i : i + 6]) in s[i + 9 :] for i in range(len(s) - 14))

    def apart(f, r):
        return not runs(f, 8) & runs(revcomp_text(r), 8) and f[-6:] not in revcomp_text(r) and r[-6:] not in revcomp_text(f)

    left = [x for x in ok if usable(text[x[0] : x[0] + x[1]])]
    right = [x for x in ok if usable(revcomp_text(text[x[0] : x[0] + x[1]]))]
    pairs = sorted((round(a[2] + b[2], 6), a[0], a[1], b[0], b[1]) for a in left for b in right if 80 <= b[0] + b[1] - a[0] <= 200 and a[0] + a[1] <= b[0] and apart(text[a[0] : a[0] + a[1]], revcomp_text(text[b[0] : b[0] + b[1]])))[:15]
    assert [(round(x["penalty"], 6), x["left_start"], x["left_length"], x["right_start"], x["right_length"]) for x in got] == [(round(p[0], 6), *p[1:]) for p in pairs]
    assert got[0]["pair"] == "t_pair0" and got[0]["reverse"] == revcomp_text(text[got[0]["right_start"] :][: got[0]["right_length"]])


def test_route():
    assert [project.route(a, b) for a, b in ((True, True), (False, True), (False, False))] == ["blocks", "grid", "kmers"]
    with pytest.raises(TypeError):
        project.route()


def test_differences_mark_planted_variants(spark):
    from primeweft.operators import align

    r = random.Random(11)
    t = "".join(r.choice("ACGT") for _ in range(600))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    w = t[:100] + other[t[100]] + t[101:300] + t[304:450] + "GATTACA" + t[450:]
    start, cs = align.differences(t, w)
    assert start == 0
    df = spark.createDataFrame([("t", start, cs)], "template string, r_start long, cs string")
    marked = sorted(x["pos"] for x in mask.variants(df, F.lit(600)).collect())
    assert 100 in marked and len([p for p in marked if 285 <= p <= 320]) >= 4 and any(430 <= p <= 460 for p in marked)
    assert len(marked) <= 40 and align.differences(t, "ACGT" * 20) is None
    got = align.align_windows(spark.createDataFrame([("t", t)], "template string, sequence string"), spark.createDataFrame([("h1", t), ("h2", "A" * 50)], "haplotype string, sequence string")).collect()
    assert [(x["haplotype"], x["cs"]) for x in got] == [("h1", ":600")]


def test_what_a_window_join_finds_is_exchanged_once(spark):
    targets = spark.createDataFrame([(1, "c", 100, 400), (2, "c", 900, 1200)], "k long, chrom string, start long, end long")
    anchors = spark.createDataFrame([("c", i * 40, f"q{i % 2}", i * 40, i * 40 + 10) for i in range(30)], "t_name string, t_start long, q_contig string, q_start long, q_end long")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = project.anchor_windows(targets, anchors, ["k"], 10, 10)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["k"] for r in found.collect()) == [1, 2]
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert plan.count("Exchange hashpartitioning") == 3
