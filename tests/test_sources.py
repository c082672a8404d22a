import gzip
import random
import zlib

import pytest
from primeweft import cli
from primeweft.operators import pcr, project, search
from primeweft.plans import verify as plans
from primeweft.sources import fasta, readers
from primeweft.streaming import incremental
from pyspark.sql import functions as F


def member(raw):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = len(body) + 26
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + (size - 1).to_bytes(2, "little") + body + zlib.crc32(raw).to_bytes(4, "little") + len(raw).to_bytes(4, "little")


def blocked(text, size=60_000):
    return b"".join(member(text[i : i + size].encode()) for i in range(0, len(text), size)) + member(b"")


def test_fasta(spark, tmp_path):
    text = ">c1 some words\r\nACGT\r\nac gt\n>c2\n\n>c3\n" + "\n".join("ACGTN" for _ in range(9)) + "\n"
    plain, packed = tmp_path / "a.fa", tmp_path / "b.fa.gz"
    plain.write_text(text)
    packed.write_bytes(blocked(text, 30))
    for p in (plain, packed):
        df = readers.read_fasta(spark, str(p), 10)
        whole = {r["chrom"]: r["sequence"] for r in readers.whole_contigs(df).collect()}
        assert whole == {"c1": "ACGTacgt", "c2": "", "c3": "ACGTN" * 9}
        assert {r["chrom"]: r["length"] for r in readers.contig_lengths(df).collect()}["c3"] == 45
        parts = [tuple(r) for r in readers.read_fasta(spark, str(p), 10, 4).where("chrom = 'c3'").select("base", "own", "sequence").orderBy("base").collect()]
        assert [(b, o, len(s)) for b, o, s in parts] == [(0, 10, 14), (10, 10, 14), (20, 10, 14), (30, 10, 14), (40, 5, 5)]
        q = spark.createDataFrame([("NACG",), ("TNAC",)], "query string")
        cut, one = (search.search(x.select("chrom", *y, "sequence"), q, 0) for x, y in ((readers.read_fasta(spark, str(p), 10, 4), ("base", "own")), (readers.whole_contigs(df), ())))
        assert sorted(map(str, cut.collect())) == sorted(map(str, one.collect())) and cut.count() > 10
    both = readers.read_fasta(spark, [str(plain), str(packed)])
    assert sorted((r["file"], r["contig_idx"]) for r in both.collect()) == sorted((readers.qualified(spark, str(p)), i) for p in (plain, packed) for i in range(3))
    assert readers.scan_path(spark, str(tmp_path / "b.fa")) == str(packed)
    assert readers.scan_path(spark, str(plain)) == str(plain)
    with pytest.raises(FileNotFoundError):
        readers.scan_path(spark, str(tmp_path / "none.fa"))
    (tmp_path / "b.fa.paf").write_text("")
    assert readers.sidecar(spark, str(packed), ".paf") == str(tmp_path / "b.fa.paf")


def test_fasta_over_many_splits(spark, tmp_path):
    r = random.Random(4)
    contigs = [(f"c{i}", "".join(r.choice("ACGTN") for _ in range(n))) for i, n in enumerate([5, 400_000, 0, 70, 250_000, 1])]
    text = "".join(f">{n} x\n" + "".join(s[i : i + 61] + "\n" for i in range(0, len(s), 61)) for n, s in contigs)
    plain, packed = tmp_path / "a.fa", tmp_path / "b.fa.gz"
    plain.write_text(text)
    packed.write_bytes(blocked(text, 20_000))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        for p in (plain, packed):
            df = readers.read_fasta(spark, str(p), 10_000, 100, range_=40_000)
            rows = df.orderBy("contig_idx", "base").collect()
            assert len(fasta._lines(spark, [str(p)], 40_000).select("block").distinct().collect()) > 4
            found = {}
            for x in rows:
                assert x["base"] == len(found.get((x["contig_idx"], x["chrom"]), ""))
                found[x["contig_idx"], x["chrom"]] = found.get((x["contig_idx"], x["chrom"]), "") + x["sequence"][: x["own"]]
            assert found == {(i, n): s for i, (n, s) in enumerate(contigs)}
            for x in rows:  # each chunk goes on into what follows it
                whole = contigs[x["contig_idx"]][1]
                assert x["sequence"] == whole[x["base"] : x["base"] + x["own"] + 100][: len(x["sequence"])]
                assert len(x["sequence"]) >= min(x["own"] + 100, len(whole) - x["base"])
            want = spark.createDataFrame([("k", "c1", 9_000, 31_000), ("l", "c1", -5, 3), ("m", "c4", 249_000, 260_000)], "k string, q_name string, lo long, hi long").withColumn("strand", F.lit("+"))
            got = {x["k"]: x["bases"] for x in project.fetch(want, df.drop("file"), []).collect()}
            assert got == {"k": contigs[1][1][9_000:31_000], "l": contigs[1][1][:3], "m": contigs[4][1][249_000:]}
            probes = {(x["chrom"], x["at"]): x["probe"] for x in project.probes(df.select("chrom", "base", "own", "sequence"), 1000, 5, 100_000).collect()}
            assert probes == {(n, i): s[i : i + 5] for n, s in contigs if len(s) >= 100_000 for i in range(0, len(s) - 4, 1000) if "N" not in s[i : i + 5]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_broken_fasta_raises(spark, tmp_path):
    (tmp_path / "p.fa.gz").write_bytes(gzip.compress(b">a\nACGT\n"))
    whole = blocked(">a\n" + "ACGT\n" * 9000, 9000)
    (tmp_path / "c.fa.gz").write_bytes(whole[:-40])
    (tmp_path / "h.fa").write_text("ACGT\n>a\nA\n")
    for name in ("p.fa.gz", "c.fa.gz", "h.fa"):
        with pytest.raises(Exception, match="gzip|header"):
            readers.read_fasta(spark, str(tmp_path / name)).collect()


def test_bgzf_members():
    data = member(b"ACGT" * 100) + member(b"") + member(b"x")
    parts = readers.bgzf_members(data)
    assert b"".join(readers.inflate_member(data[a : a + n]) for a, n in parts) == b"ACGT" * 100 + b"x"
    for bad in (data[:-3], gzip.compress(b"plain")):
        with pytest.raises(ValueError):
            readers.bgzf_members(bad)


def test_tables(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("Name,Coords,FWD,Rev\n a ,chr1:1-2, acgt ,GG\n,x,y,z\n")
    assert [tuple(r) for r in readers.read_primers(spark, str(csv)).collect()] == [("a", "chr1:1-2", "ACGT", "GG")]
    csv.write_text("Name,Coords,FWD\na,b,c\n")
    with pytest.raises(ValueError):
        readers.read_primers(spark, str(csv))
    paf = tmp_path / "x.paf"
    paf.write_text("q\t9\t1\t5\t+\tchr1\t99\t10\t14\t4\t4\t60\ttp:A:P\tcg:Z:4M\nshort\tline\nq\t9\t1\t5\t-\tchr2\t99\t10\t14\t4\t4\t60\n")
    rows = readers.read_paf(spark, str(paf)).collect()
    assert [(r["t_name"], r["cigar"]) for r in rows] == [("chr1", "4M"), ("chr2", None)]
    assert readers.read_paf(spark, str(paf), "chr1", 14, 20).count() == 0 and readers.read_paf(spark, str(paf), "chr1", 13, 20).count() == 1
    grid = tmp_path / "g.tsv.gz"
    grid.write_bytes(gzip.compress(b"#step=10 probe=5\nchr1\t0\t5\tq\t1\t6\t+\nbad\n"))
    anchors, meta = readers.read_grid(spark, str(grid))
    assert meta == {"step": "10", "probe": "5"} and anchors.first()["q_start"] == 1
    readers.write_grid(anchors, str(tmp_path / "grid"), {"step": 10, "probe": 5})
    again, meta = readers.read_grid(spark, str(tmp_path / "grid"))
    assert meta == {"step": "10", "probe": "5"} and again.drop("path").collect() == anchors.drop("path").collect()
    assert readers.haplotype_name("/x/HG1_hap2.fa.gz") == "HG1#hap2" and readers.threads({"search": {"threads": 0}}) is None


def test_manifest_selection(spark):
    index = spark.createDataFrame([(i, s, h, f"s3://b/k{s}") for i, (s, h) in enumerate([("B", 2), ("A", 1), ("B", 1), ("A", 2), ("C", 1), ("D", 1)])], "line_no long, sample_id string, haplotype int, assembly string")
    meta = spark.createDataFrame([(0, "A", "YRI"), (1, "B", "CEU"), (2, "A", "CHB"), (3, "C", "??"), (4, "D", " ")], "line_no long, sample_id string, population_abbreviation string")
    r = readers.join_metadata(index, meta).cache()
    got = {x["sample_id"]: (x["superpop"], x["population"]) for x in r.collect()}
    assert got == {"A": ("EAS", "CHB"), "B": ("EUR", "CEU"), "C": ("UNK", "??"), "D": ("UNK", "NA")}
    assert r.first()["assembly"].startswith("https://b.s3.amazonaws.com/k")
    assert [(x["sample_id"], x["haplotype"]) for x in readers.select_diverse(r).collect()] == [("B", 1), ("B", 2), ("A", 1), ("A", 2)]


def test_verify_end_to_end_and_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    r = random.Random(1)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    region = dna(3000)
    f, rv = region[1000:1020], plans.revcomp_text(region[1180:1200])
    (tmp_path / "bb.fa").write_text(">chr1\n" + dna(500) + region + "\n")
    (tmp_path / "h_hap1.fa").write_text(">x\n" + dna(900) + region + "\n")
    (tmp_path / "h_hap2.fa").write_text(">y\n" + dna(4000) + "\n")
    (tmp_path / "s.tsv").write_text(f"sample\thap\tpop\tpath\n# c\nh\t1\tAFR\t{tmp_path}/h_hap1.fa\nh\t2\tAFR\t{tmp_path}/h_hap2.fa\n")
    (tmp_path / "p.csv").write_text(f"primer_id,target,forward,reverse\nt1,\"chr1:1,500-1,700\",{f},{rv}\n")
    args = ["verify", "--primers", f"{tmp_path}/p.csv", "--backbone", f"{tmp_path}/bb.fa", "--samples", f"{tmp_path}/s.tsv", "--target-assembly", "chm13", "--mode", "rule", "--outdir", f"{tmp_path}/out"]
    assert cli.main(args) == 0
    import json

    saved = json.load(open(tmp_path / "out" / "verify.json"))["pairs"][0]
    assert [(c["haplotype"], c["status"], c["on_sizes"]) for c in saved["cells"]] == [("h#hap1", "pass", [200]), ("h#hap2", "uncertain", [])]
    tsv = (tmp_path / "out" / "verify.tsv").read_text().split("\n")
    assert dict(zip(tsv[0].split("\t"), tsv[1].split("\t"), strict=True))["target"] == "chr1:1,500-1,700"
    assert cli.main(["rerender", "--results", f"{tmp_path}/out/verify.json", "--outdir", f"{tmp_path}/again"]) == 0
    assert cli.main(["selftest", "--outdir", f"{tmp_path}/st"]) == 0
    assert cli.main([*args[:4], f"{tmp_path}/none.fa", *args[5:]]) == 2

    bed = ["design", "--target", "chr1:1000-1800", "--backbone", f"{tmp_path}/bb.fa", "--samples", f"{tmp_path}/s.tsv", "--mode", "rule", "--flank", "50", "--outdir", f"{tmp_path}/d", "--stages", f"{tmp_path}/stages"]
    assert cli.main(bed) == 0
    made = json.load(open(tmp_path / "d" / "results.json"))["pairs"]
    assert len(made) == 5 and all(m["passed"] and m["evaluable"] == 1 and m["n_uncertain"] == 1 for m in made)
    first = [m["pair"] for m in made]
    assert cli.main(bed) == 0 and [m["pair"] for m in json.load(open(tmp_path / "d" / "results.json"))["pairs"]] == first

    # other parameters don't get the tables of an earlier run
    assert cli.main([*bed, "--top-k", "2"]) == 0 and len(json.load(open(tmp_path / "d" / "results.json"))["pairs"]) == 2

    pairs, contigs, loci = plans.example(spark)
    config = pcr.Evaluation("rule", min_product=80, max_product=200)
    contigs.where("haplotype < 'HG_m'").write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.evaluate_stream(spark, str(tmp_path / "in"), pairs, loci, config, str(tmp_path / "cells"), str(tmp_path / "cp")).awaitTermination()
    run()
    contigs.where("haplotype >= 'HG_m'").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    m = incremental.metrics(spark, str(tmp_path / "cells")).first()
    assert (m["total"], m["coverage"]) == (5, 0.5)


def test_a_variant_in_a_primer_and_the_grid_route(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    r = random.Random(9)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    region = dna(40_000)
    f, rv = region[20_000:20_020], plans.revcomp_text(region[20_180:20_200])
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    snp = lambda at: region[:at] + other[region[at]] + region[at + 1 :]
    haps = {1: dna(900) + region, 2: dna(900) + snp(20_003), 3: dna(900) + snp(20_196), 4: dna(900) + snp(20_019)}
    (tmp_path / "bb.fa").write_text(">chr1\n" + region + "\n")
    lines = []
    for h, text in haps.items():
        (tmp_path / f"h_hap{h}.fa").write_text(">x\n" + text + "\n")
        lines.append(f"h\t{h}\tAFR\t{tmp_path}/h_hap{h}.fa")
    (tmp_path / "s.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "p.csv").write_text(f"primer_id,target,forward,reverse\nt1,chr1:20000-20200,{f},{rv}\n")
    args = ["verify", "--primers", f"{tmp_path}/p.csv", "--backbone", f"{tmp_path}/bb.fa", "--samples", f"{tmp_path}/s.tsv", "--target-assembly", "chm13", "--mode", "rule", "--outdir", f"{tmp_path}/out"]
    import json

    def statuses():
        assert cli.main(args) == 0
        return {c["haplotype"]: (c["status"], c["on_sizes"]) for c in json.load(open(tmp_path / "out" / "verify.json"))["pairs"][0]["cells"]}

    want = {"h#hap1": ("pass", [200]), "h#hap2": ("pass", [200]), "h#hap3": ("pass", [200]), "h#hap4": ("dropout", [])}
    assert statuses() == want
    # grids that the command writes are read back and lead to the same cells
    for h in (1, 2, 4):
        assert cli.main(["grid", "--backbone", f"{tmp_path}/bb.fa", "--fasta", f"{tmp_path}/h_hap{h}.fa", "--out", f"{tmp_path}/h_hap{h}.fa.anchors.tsv.gz", "--step", "2000", "--probe", "500", "--least", "1000"]) == 0
    assert readers.read_grid(spark, f"{tmp_path}/h_hap1.fa.anchors.tsv.gz")[0].count() > 15
    assert statuses() == want


def test_a_large_chromosome_of_a_grid_is_dealt_over_files(spark, tmp_path):
    rows = [("chr1", i, i + 5, "q", i, i + 5, "+") for i in range(4000)] + [("chr2", 3, 8, "q", 1, 6, "-")]
    anchors = spark.createDataFrame(rows, "t_name string, t_start long, t_end long, q_contig string, q_start long, q_end long, strand string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        readers.write_grid(anchors, str(tmp_path / "grid"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = [[x.split("\t") for x in gzip.open(p, "rt").read().splitlines()] for p in sorted((tmp_path / "grid").glob("*.gz"))]
    assert max(map(len, files)) < 2000 and sum(map(len, files)) == 4001
    assert all([int(x[1]) for x in f if x[0] == c] == sorted(int(x[1]) for x in f if x[0] == c) for f in files for c in ("chr1", "chr2"))
    assert sorted(tuple(r) for r in readers.read_grid(spark, str(tmp_path / "grid"))[0].drop("path").collect()) == sorted(rows)


def test_ranges_of_blocked_files_are_read_together(spark, tmp_path):
    """Tasks of several ranges give the lines and ranges that a task for each gives, and read little beyond their own bytes."""
    from primeweft.plans.catalog_files import write_blocked
    from primeweft.sources import fasta

    lines = [f">c{i}" if i % 50 == 0 else "ACGT" * (i % 17) for i in range(4000)]
    files = write_blocked(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), f"file://{tmp_path}/b", 700)
    found = []
    for task in (500, 6000):
        reader = fasta._Reader({"uris": "\n".join(files), "range": "500", "task": str(task)})
        parts = reader.partitions()
        found.append(([x for p in parts for b in reader.read(p) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], len(parts)))
    (one, many), (other, few) = found
    assert one == other and [x[2] for x in one] == lines and len({x[1] for x in one}) > 5
    assert few * 4 < many
