"""Banded alignments against the full table, and difference strings against their definition."""

import random
import re

import numpy as np
import pytest

from primeweft.operators import align


def full(a: str, b: str, c: align.Costs) -> int:
    far = 10**9
    h = [[far] * (len(b) + 1) for _ in range(len(a) + 1)]
    e, f = [r[:] for r in h], [r[:] for r in h]
    h[0][0] = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i:
                e[i][j] = min(h[i - 1][j] + c.open + c.extend, e[i - 1][j] + c.extend)
            if j:
                f[i][j] = min(h[i][j - 1] + c.open + c.extend, f[i][j - 1] + c.extend)
            if i and j:
                h[i][j] = h[i - 1][j - 1] + (c.mismatch if a[i - 1] != b[j - 1] else 0)
            h[i][j] = min(h[i][j], e[i][j], f[i][j])
    return h[-1][-1]


def cost_of(a: str, b: str, steps, c: align.Costs) -> int:
    i = j = total = 0
    before = None
    for s in steps.tolist():
        if s == align.BOTH:
            total += c.mismatch * (a[i] != b[j])
        else:
            total += c.extend + c.open * (s != before)
        i += s != align.EXTRA
        j += s != align.GONE
        before = s
    assert (i, j) == (len(a), len(b))
    return total


def changed(rng, s: str, share: float) -> str:
    out = []
    for c in s:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(rng.choice("ACGT") if x < 2 * share / 3 else c)
        if x > 1 - share / 3:
            out.append("".join(rng.choice("ACGT") for _ in range(rng.choice([1, 1, 2, 30]))))
    return "".join(out)


@pytest.mark.parametrize("costs", [align.Costs(), align.Costs(1, 0, 1), align.Costs(3, 7, 1)])
def test_costs_equal_the_full_table(costs):
    rng = random.Random(1)
    made = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [("", "ACG"), ("ACG", ""), ("", ""), ("A", "A"), ("A", "C"), ("AAAA", "TTTTTTTTTT")]
    pairs += [(x := made(rng.randrange(1, 90)), changed(rng, x, rng.choice([0.02, 0.2, 0.6]))) for _ in range(150)]
    pairs += [(made(rng.randrange(70)), made(rng.randrange(70))) for _ in range(60)]
    pairs += [(x[:20] + x[-20:], x) for x in (made(300), made(120))] + [(x, x[:30] + x[-30:]) for x in (made(250),)]
    cost, steps = align.aligned([(a.encode(), b.encode()) for a, b in pairs], costs)
    for (a, b), c, s in zip(pairs, cost.tolist(), steps, strict=True):
        assert c == full(a, b, costs) == cost_of(a, b, s, costs), (a, b)


def test_small_tables_give_the_same(monkeypatch):
    rng = random.Random(2)
    pairs = [(x := "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 200))), changed(rng, x, 0.3)) for _ in range(40)]
    raw = [(a.encode(), b.encode()) for a, b in pairs]
    want = align.aligned(raw)[0].tolist()
    monkeypatch.setattr(align, "CELLS", 1)
    monkeypatch.setattr(align, "BAND", 1)
    assert align.aligned(raw)[0].tolist() == want


def rebuilt(template: str, start: int, cs: str) -> tuple[str, str]:
    """The stretches of template and window that a difference string tells."""
    t, w, i = "", "", start
    for op, x in re.findall(r"([:*+-])([0-9a-zA-Z]+)", cs):
        if op == ":":
            t, w, i = t + template[i : i + int(x)], w + template[i : i + int(x)], i + int(x)
        elif op == "*":
            t, w, i = t + x[0].upper(), w + x[1].upper(), i + 1
        elif op == "-":
            t, i = t + x.upper(), i + len(x)
        else:
            w += x.upper()
    return t, w


def test_difference_strings_rebuild_both_sequences():
    rng = random.Random(3)
    pairs = []
    for _ in range(40):
        t = "".join(rng.choice("ACGT") for _ in range(600))
        pairs.append((t, changed(rng, t, rng.choice([0.0, 0.01, 0.05]))))
    for (t, w), found in zip(pairs, align.all_differences(pairs), strict=True):
        start, cs = found
        a, b = rebuilt(t, start, cs)
        assert t[start:].startswith(a) and b in w
        assert not re.search(r":\d+:|-[a-z]+-|\+[a-z]+\+", cs)


def test_a_deleted_base_beside_a_substitution_stay_two_differences():
    rng = random.Random(4)
    t = "".join(rng.choice("ACGT") for _ in range(200))
    while t[100] == t[101] or t[99] == t[100]:
        t = "".join(rng.choice("ACGT") for _ in range(200))
    other = "A" if t[107] != "A" else "C"
    w = t[:100] + t[101:107] + other + t[108:]
    start, cs = align.differences(t, w)
    assert (start, cs) == (0, f":100-{t[100].lower()}:6*{t[107].lower()}{other.lower()}:92")


def test_windows_without_an_anchor_and_nulls(spark):
    template = spark.createDataFrame([("t", "ACGTTGCAAGCTTCGATGCAACGGTTACGATC")], "template string, sequence string")
    windows = spark.createDataFrame([("a", "ACGTTGCAAGCTTCGATGCAACGGTTACGATC"), ("b", None), ("c", ""), ("d", "T" * 40), ("e", "acgttgcaagcttcgatgcaacggttacgatc")], "haplotype string, sequence string")
    got = {r["haplotype"]: (r["r_start"], r["cs"]) for r in align.align_windows(template, windows).collect()}
    assert got == {"a": (0, ":32"), "e": (0, ":32")}
    own = windows.withColumn("template", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("t"))
    assert align.align_windows(template, own).count() == 2
