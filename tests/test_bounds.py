"""Bounds of each pair in one search, and the comparison of tables."""

import random

from primeweft.functions.sequences import revcomp_text
from primeweft.operators import pcr, search
from primeweft.plans import stages, verify as plans


def test_one_search_for_pairs_of_different_bounds(spark, monkeypatch):
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs, contigs = [], []
    for i, size in enumerate((200, 3000, 9000)):
        product = made(size)
        pairs.append((f"p{i}", product[:20], revcomp_text(product[-20:]), size))
        contigs.append(("h", f"c{i}", i, made(500) + product + made(500)))
    calls = []
    whole = search.search
    monkeypatch.setattr(search, "search", lambda *a, **k: calls.append(1) or whole(*a, **k))
    frame = spark.createDataFrame(pairs, "pair string, forward string, reverse string, expected_size long")
    loci = spark.createDataFrame([(f"p{i}", "h", f"c{i}", 400, 500 + p[3] + 100) for i, p in enumerate(pairs)], "pair string, haplotype string, chrom string, start long, end long")
    made_contigs = spark.createDataFrame(contigs, "haplotype string, chrom string, contig_idx int, sequence string")
    cells, summary = plans.verify(frame, loci, made_contigs, pcr.Evaluation("rule"), 2000)
    got = {r["pair"]: (r["status"], r["on_sizes"], r["size_flag"]) for r in cells.collect()}
    assert got == {"p0": ("pass", [200], False), "p1": ("pass", [3000], False), "p2": ("pass", [9000], False)}
    assert len(calls) == 1 and summary.count() == 3


def test_a_product_over_its_own_pairs_bound_is_none(spark):
    sites = [(p, s, a, a + 20, r) for p in ("near", "far") for s, a, r in (("+", 100, "F"), ("-", 580, "R"), ("-", 1280, "R"))]
    bounds = {"near": 500, "far": 1200}
    rows = [(p, s, a, b, r, bounds[p]) for p, s, a, b, r in sites]
    df = spark.createDataFrame(rows, "pair string, strand string, start long, end long, role string, most long")
    got = {(r["pair"], r["size"]) for r in pcr.amplicons(df, ["pair"], 40, "most").collect()}
    assert got == {("near", 500), ("far", 500), ("far", 1200)}
    for p, most in bounds.items():
        assert {r["size"] for r in pcr.amplicons(df.where(f"pair = '{p}'").drop("most"), ["pair"], 40, most).collect()} == {s for q, s in got if q == p}


def test_comparison_is_null_safe_and_has_no_nested_loop(spark):
    kind = "a string, b long, x string, y long"
    one = spark.createDataFrame([("p", 1, "s", 1), ("p", None, "s", None), ("q", 2, None, 3), ("gone", 1, "s", 1), (None, 1, "s", 1)], kind)
    two = spark.createDataFrame([("p", 1, "s", 1), ("p", None, "s", 4), ("q", 2, "t", 5), ("new", None, "s", 1), (None, 1, "s", 1)], kind)
    told = stages.compared(one, two, ["a", "b"], ["x", "y"])
    assert sorted((str(r["a"]), str(r["b"]), r["side"], r["fields"]) for r in told.collect()) == [("gone", "1", "missing", []), ("new", "None", "new", []), ("p", "None", "differs", ["y"]), ("q", "2", "differs", ["x", "y"])]
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
