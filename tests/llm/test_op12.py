"""Collocations against a plain count."""

import random
import re
from collections import Counter

import pytest
from primeweft.llm.op12_collocations import collocations, count_phrases


def plain(docs, least, share, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for d in (1, 2, 3):
                f.update((lang, *words[i : i + d]) for i in range(len(words) - d + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in found.items():
        lang, words = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(words)] == words for i in range(1, len(q) - len(words) + 1)) for q, b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, rows in out.items() for r, x in enumerate(sorted(rows)[:top]))


def made(seed, words=("a", "b", "cc", "D", "é", "\x01", "ab\x02", "x-y"), docs=60):
    rng = random.Random(seed)
    gaps = [" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\x0b", "\r\n"]
    text = lambda: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "de", "de", None, "zz"]), text()) for _ in range(docs)] + [("en", None), (None, ""), ("de", " . "), ("qq", "only these words")]


@pytest.mark.parametrize(("seed", "shard", "span", "places", "top"), [(1, 1 << 23, 1 << 23, 1 << 19, 2000), (2, 100, 64, 7, 5), (3, 1, 200, 1, 2000), (4, 4000, 50, 30, 3)])
def test_equals_a_plain_count(spark, seed, shard, span, places, top):
    docs = made(seed)
    df = spark.createDataFrame([(lang, t, i, "x") for i, (lang, t) in enumerate(docs)], "lang string, text string, f int, w1 string").repartition(3)
    got = collocations(df, 5, 50, top, shard, span, places)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 5, 50, top)


def test_counts_of_all_phrases(spark):
    docs = made(5, docs=20)
    df = spark.createDataFrame(docs, "lang string, text string")
    found = {tuple(None if x is None else bytes(x).decode() if not isinstance(x, str) else x for x in r[:-1]): r[-1] for r in count_phrases(df, 1, 2, 50, 40, 9).where("w1 is not null").collect()}
    f = Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            for d in (1, 2):
                f.update((lang or "und", *words[i : i + d], *[None] * (2 - d)) for i in range(len(words) - d + 1))
    assert found == f


def test_a_hot_phrase_and_equal_rows(spark):
    docs = [("en", "new york new york city")] * 500 + made(6, docs=10)
    got = collocations(spark.createDataFrame(docs, "lang string, text string").repartition(5), 5, 50, 2000, 200, 100, 50)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 5, 50, 2000)


def test_products_over_64_bits(spark):
    from primeweft.llm.op12_collocations import _score
    from pyspark.sql import functions as F

    a, left, right = 24_000_000_007, 900_000_000_000_017, 30_000_000_000_019
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(_score(F.col("a"), F.col("l"), F.col("r")).cast("long")).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_a_long_text_and_an_empty_table(spark):
    rng = random.Random(8)
    docs = [("en", " ".join(rng.choice("abcdefg") for _ in range(30_000))), ("en", "q")]
    got = collocations(spark.createDataFrame(docs, "lang string, text string"), 10, 50, 2000, 1000, 5000, 4000)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 10, 50, 2000)
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
