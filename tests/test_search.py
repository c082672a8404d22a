import random

import numpy as np
import pytest
from primeweft.functions.sequences import revcomp_text
from primeweft.operators import search as s


def rows(df):
    return sorted((r["query"], r["contig"], r["strand"], r["start"], r["mismatches"], tuple(r["offsets_3p"])) for r in df.collect())


def brute(contigs, primers, k):
    return sorted((p.upper(), c, strand, at, m, tuple(o)) for c, text in contigs for p in set(primers) for strand, at, m, o in s.naive(text, p, k))


@pytest.mark.parametrize("how", s.STRATEGIES)
@pytest.mark.parametrize("seed", range(3))
def test_strategies_agree_with_the_definition(spark, monkeypatch, how, seed):
    monkeypatch.setattr(s, "CHUNK", 700)  # hits at chunk edges must survive
    r = random.Random(seed)
    contigs = [(f"c{i}", "".join(r.choice("ACGT") for _ in range(r.randint(0, 1500)))) for i in range(3)]
    contigs.append(("soft", contigs[0][1].lower() + "N" * 40 + contigs[1][1]))
    primers = []
    for _ in range(5):
        text = max(contigs, key=lambda c: len(c[1]))[1]
        at, n = r.randrange(len(text) - 30), r.randint(18, 25)
        p = list(text[at : at + n].upper())
        for _ in range(r.randint(0, 3)):
            p[r.randrange(n)] = r.choice("ACGTN")
        primers.append("".join(p) if r.random() < 0.5 else revcomp_text("".join(p)))
    primers += ["ACGTACGTACGTACGTACGT", primers[0], "NNNNNNNNNNNNNNNNNN"]
    df = spark.createDataFrame(contigs, "contig string, sequence string")
    q = spark.createDataFrame([(p,) for p in primers], "query string")
    assert rows(s.search(df, q, 3, how)) == brute(contigs, primers, 3)


def test_planted_site_is_found_and_edges_count(spark):
    p = "TTGCACAGTCCAGATTGCAA"
    df = spark.createDataFrame([("a", p + "G" * 50 + revcomp_text(p)), ("b", p[:-1]), ("e", ""), ("n", None)], "contig string, sequence string")
    got = rows(s.search(df, spark.createDataFrame([(p,)], "query string"), 0))
    assert got == [(p, "a", "+", 0, 0, ()), (p, "a", "-", 70, 0, ())]


def test_a_palindrome_has_both_strands(spark):
    df = spark.createDataFrame([("a", "GGGACGTACGTCCC")], "contig string, sequence string")
    assert [x[2] for x in rows(s.search(df, spark.createDataFrame([("ACGTACGT",)], "query string"), 0))] == ["+", "-"]


def test_no_primers_and_unknown_strategy(spark):
    df = spark.createDataFrame([("a", "ACGT")], "contig string, sequence string")
    assert s.search(df, spark.createDataFrame([], "query string")).count() == 0
    with pytest.raises(ValueError):
        s.strategy("bwa")


@pytest.mark.parametrize("k", [0, 1, 3, 5])
def test_seeds_back_off_from_large_tables(spark, monkeypatch, k):
    monkeypatch.setattr(s, "ENTRIES", 0)
    r = random.Random(k)
    text = "".join(r.choice("ACGT") for _ in range(3000))
    primers = []
    for _ in range(12):
        at = r.randrange(2950)
        p = list(text[at : at + 22])
        for _ in range(r.randint(0, k)):
            p[r.randrange(22)] = r.choice("ACGT")
        primers.append("".join(p))
    kernel = s.Kernel([(p, x, strand) for p in primers for x, strand in ((p, "+"), (revcomp_text(p), "-"))], k)
    import numpy as np

    got = []
    for p, _, at, wrong in kernel.hits(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])):
        got += [(kernel.queries[int(i)].as_py(), kernel.strands[int(i)].as_py(), int(a), int(w.sum())) for i, a, w in zip(p, at, wrong, strict=True)]
    assert sorted(set(got)) == sorted({(p, strand, at, m) for p in primers for strand, at, m, _ in s.naive(text, p, k)})
    assert max(len(t[2]) for t in kernel.tables.values()) <= (k + 1) * 24


def test_the_equi_join_shuffles_no_windows_and_has_few_candidates(spark):
    q = spark.createDataFrame([("TTGCACAGTCCAGATTGCAA",)], "query string")
    df = spark.createDataFrame([("a", "ACGT" * 20)], "contig string, sequence string")
    plan = s.search(df, q, 3, "seed_join")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert s._seeds_of(20, 3, 800) == ([(0, 10), (10, 20)], 1)  # halves of 10 bases, not quarters of 5
    assert s._seeds_of(20, 3, s.ENTRIES) == (s._segments(20, 3), 0)


@pytest.mark.parametrize("how", ["arrow", "seed_join"])
def test_other_characters_count_one_base_each(spark, how):
    p = "TTGCACAGTCCAGATTGCAA"
    contigs = [("a", "é" + p[:5] + "ß" + p[6:] + "😀" + p[:12] + "n" + p[13:])]
    got = rows(s.search(spark.createDataFrame(contigs, "contig string, sequence string"), spark.createDataFrame([(p,)], "query string"), 1, how))
    assert [x[3:5] for x in got] == [(1, 1), (22, 1)]


def test_the_kernel_keeps_few_candidates_at_once(monkeypatch):
    """A run of a base that all primers ask for is compared in parts, with the same hits."""
    monkeypatch.setattr(s, "COMPARED", 1 << 10, raising=False)
    r = random.Random(1)
    primers = ["A" * 10 + "".join(r.choice("ACGT") for _ in range(10)) for _ in range(40)]
    text = "A" * 3000 + primers[7] + "C" + primers[9]
    kernel = s.Kernel([(p, p, "+") for p in primers], 3)
    data = np.frombuffer(text.encode(), np.uint8)
    most = max(len(p) for p, _ in kernel.candidates(data))
    assert most <= (1 << 10) + 2 * 40 * len(s._changes(10, 1))
    got = sorted((primers[i], int(a), int(w.sum())) for p, _, at, wrong in kernel.hits(data, np.array([0, len(data)])) for i, a, w in zip(p, at, wrong, strict=True))
    assert got == sorted((p, at, m) for p in primers for strand, at, m, _ in s.naive(text, p, 3) if strand == "+")
