"""Chains of k-mers against a plain dynamic programme, and targets with planted insertions and deletions."""

import random

import numpy as np
import pytest

from primeweft.functions.sequences import revcomp_text
from primeweft.operators import chain, project, search


def made(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def plain(anchors, reach):
    """Best (score, root) of each anchor by definition, over all predecessors."""
    best = []
    for i, (lo, hi, start, end, votes) in enumerate(anchors):
        own = (hi - lo, start, lo, votes)
        for j, (lo2, hi2, start2, end2, _) in enumerate(anchors[:i]):
            gain = min(hi - hi2, end - end2, hi - lo)
            if gain > 0 and lo2 < lo and start2 < start and start - end2 <= reach and lo - hi2 <= reach:
                turn = abs((start - lo) - (start2 - lo2))
                score = best[j][0] + gain - (8 + turn // 32 if turn else 0)
                own = max(own, (score, *best[j][1:3], best[j][3] + votes))
        best.append(own)
    return best


@pytest.mark.parametrize("seed", range(30))
def test_scores_equal_the_definition(seed):
    rng = random.Random(seed)
    rows = set()
    for _ in range(rng.randrange(1, 60)):
        q, at, n = rng.randrange(0, 400), rng.randrange(0, 900), rng.randrange(15, 60)
        rows.add((q, q + n, at, at + n, n - 14))
    rows = sorted(rows, key=lambda r: (r[2], r[0], r[1], r[3], r[4]))
    got = chain.chained(*(np.array(c, np.int64) for c in zip(*rows, strict=True)), reach=80)
    want = {}
    for (_, hi, _, end, _), (score, start, lo, votes) in zip(rows, plain(rows, 80), strict=True):
        want[start, lo] = max(want.get((start, lo), (0,)), (score, votes, hi, end))
    assert {(c[1], c[3]): (c[0], c[5]) for c in got}.keys() <= want.keys()
    assert max(c[0] for c in got) == max(x[0] for x in want.values())
    scores = {}
    for c in got:
        scores[c[1], c[3]] = max(scores.get((c[1], c[3]), 0), c[0])
    assert all(scores[r] == want[r][0] for r in scores)


@pytest.mark.parametrize("sent", [project.SENT, 0])
def test_planted_insertions_and_deletions(spark, monkeypatch, sent):
    monkeypatch.setattr(project, "SENT", sent)
    rng = random.Random(11)
    targets, contigs, want = [], [], {}
    for i, size in enumerate([0, 1, 10, 29, 30, 60, 200, 999, 1000]):
        for kind in ("inserted", "deleted"):
            name, base = f"{kind}{size}", made(rng, 4000)
            own = base[:2000] + made(rng, size) + base[2000:] if kind == "inserted" else base[:2000] + base[2000 + size :]
            left = made(rng, 700 + i)
            minus = i % 2 == 1
            contigs.append((name, left + (revcomp_text(own) if minus else own) + made(rng, 500)))
            targets.append((name, base))
            want[name] = (name, len(left), len(left) + len(own), "-" if minus else "+")
    made_targets, made_contigs = spark.createDataFrame(targets, "target string, bases string"), spark.createDataFrame(contigs, "chrom string, sequence string")
    got = {r["target"]: r for r in project.chain_projection(made_targets, made_contigs, []).collect()}
    assert {t: (r["chrom"], r["start"], r["end"], r["strand"]) for t, r in got.items()} == want
    assert all(r["mapq"] == 60 and not r["ambiguous"] and r["runner_up"] is None for r in got.values())


def test_two_copies_are_ambiguous_and_a_worse_one_is_not(spark):
    rng = random.Random(12)
    base = made(rng, 900)
    worse = "".join(c if rng.random() > 0.06 else rng.choice("ACGT") for c in base)
    contigs = [("two", base + made(rng, 8000) + base), ("worse", made(rng, 30) + worse)]
    target = spark.createDataFrame([("t", base)], "target string, bases string")
    got = project.chain_projection(target, spark.createDataFrame(contigs, "chrom string, sequence string"), []).collect()
    assert len(got) == 1 and got[0]["ambiguous"] and got[0]["mapq"] == 0 and got[0]["runner_up"] == 900
    assert [x["n"] for x in got[0]["rivals"]] == [2]
    one = spark.createDataFrame([("one", made(rng, 50) + base), contigs[1]], "chrom string, sequence string")
    got = project.chain_projection(target, one, []).collect()
    assert (got[0]["chrom"], got[0]["start"], got[0]["end"], got[0]["ambiguous"]) == ("one", 50, 950, False)


def test_rows_of_several_keys_and_batches(spark):
    rng = random.Random(13)
    base = [made(rng, 600) for _ in range(3)]
    targets = spark.createDataFrame([(f"t{i}", b) for i, b in enumerate(base)], "target string, bases string")
    contigs = spark.createDataFrame([(h, f"c{i}", made(rng, 40 * i + h) + b[:300] + made(rng, 50 * h) + b[300:]) for h in range(4) for i, b in enumerate(base)], "haplotype long, chrom string, sequence string")
    sought = targets.join(contigs.select("haplotype").distinct(), how="cross")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r["haplotype"], r["target"]): (r["chrom"], r["start"], r["end"]) for r in project.chain_projection(sought, contigs, ["haplotype"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(h, f"t{i}"): (f"c{i}", 40 * i + h, 40 * i + h + 600 + 50 * h) for h in range(4) for i in range(3)}


def test_nothing_to_place(spark):
    contigs = spark.createDataFrame([("c", "ACGT" * 100)], "chrom string, sequence string")
    assert project.chain_projection(spark.createDataFrame([("t", None), ("n", "N" * 50), ("short", "ACG")], "target string, bases string"), contigs, []).count() == 0


def test_matches_of_repeats_come_in_parts():
    table = search.SeedTable(["AC" * 200], 15)
    text = np.frombuffer(b"AC" * (1 << 14), np.uint8)
    sizes = [len(part[0]) for part in table.matches(text, np.array([0, len(text)]))]
    assert sum(sizes) == (len(text) - 14) * 193
    assert max(sizes) <= search.MATCHED + 193


def test_parts_of_matches_are_all_matches(monkeypatch):
    monkeypatch.setattr(search, "STRIDE", 64)
    monkeypatch.setattr(search, "MATCHED", 5)
    rng = random.Random(14)
    base = made(rng, 60)
    texts = ["AC" * 12, base, base[10:40] + "AC" * 9]
    contigs = ["AC" * 40, "", base[:30] + "N" + base[31:], "ACG", revcomp_text(base) + "AC" * 8, made(rng, 150) + base]
    text = np.frombuffer("".join(contigs).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, contigs)])
    got = sorted(x for part in search.SeedTable(texts, 15).matches(text, offsets) for x in zip(*(c.tolist() for c in part), strict=True))
    kmers = lambda s: [(i, s[i : i + 15]) for i in range(len(s) - 14) if "N" not in s[i : i + 15]]
    sought = [(n, turned, q, w) for n, t in enumerate(texts) for turned in (False, True) for q, w in kmers(revcomp_text(t) if turned else t)]
    want = sorted((int(offsets[c]) + at, c, n, turned, q) for c, s in enumerate(contigs) for at, w in kmers(s) for n, turned, q, x in sought if w == x)
    assert len(want) > 100 and got == want


def test_sent_targets_are_no_python_rows(spark):
    targets = spark.sql("SELECT 't' AS target, repeat('ACGGTCATTG', 9) AS bases")
    contigs = spark.sql("SELECT 'c' AS chrom, repeat('ACGGTCATTG', 9) AS sequence")
    assert "ExistingRDD" not in project.seed_matches(targets, contigs, [])._jdf.queryExecution().executedPlan().toString()
