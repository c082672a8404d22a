import math
import random
from collections import Counter

import numpy as np
from primeweft.llm import op2_quality as o


def brute(text):
    raw = (text or "").encode()
    words = raw.split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(8)}
    seen, duplicates = set(), 0
    for line in raw.split(b"\n"):
        if line.split():
            duplicates += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_counts(spark):
    r = random.Random(5)
    words = ["a", "b", "the", "né", "x|y", " ", "$%", "漢字"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", " ", "\n", "\t", "  "]) for _ in range(r.choice([0, 1, 19, 20, 60, 400]))), r.choice(["en", None, "fr"]), 0) for i in range(150)]
    rows += [(900, None, "en", 0), (901, "", None, 0), (902, "one two " * 30000, "en", 0), (None, "same\nsame\n \n \nsame", "en", 0), (1, rows[1][1], "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = sorted(map(str, (tuple(x)[:7] for x in o.quality(docs).collect())))
    assert got == sorted(map(str, ((d, *brute(t)) for d, t, _, _ in rows)))
    assert o.quality(docs.limit(0)).count() == 0


def test_distance_is_jensen_shannon():
    p, q = np.array([[1, 3, 0]]), np.array([[2, 0, 2]])
    m = [0.375, 0.375, 0.25]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert abs(o.distances(p, q)[0] - math.sqrt((kl([0.25, 0.75, 0]) + kl([0.5, 0, 0.5])) / 2)) < 1e-12


def test_verdicts(spark):
    r = random.Random(1)
    clean = lambda: " ".join(r.choice(["the", "of", "and", "river", "stone", "walks", "morning,", "light."]) for _ in range(200))
    junk = lambda: " ".join(r.choice("XQ!!! ZZ## %%% |||| 0923 @@@@").strip() * r.randint(1, 9) for _ in range(200))
    docs = spark.createDataFrame([(i, clean(), "en") for i in range(80)] + [(100 + i, junk(), "en") for i in range(8)], "doc_id long, text string, lang string")
    kept = {x.doc_id: (x.kept, x.base_failed) for x in o.quality(docs).collect()}
    assert all(kept[i] == (True, False) for i in range(80))
    assert all(kept[100 + i] == (False, False) for i in range(8))


def test_a_language_without_a_reference_rejects_nothing(spark):
    r = random.Random(2)
    english = lambda: " ".join(r.choice(["the", "of", "and", "river", "stone", "walks", "morning,", "light."]) for _ in range(200))
    other = lambda: " ".join(r.choice(["река", "камень", "утро", "свет", "идёт", "тихо", "домой"]) for _ in range(100))
    rows = [(i, english(), "en") for i in range(40)] + [(100 + i, other(), "ru") for i in range(3)] + [(200, other(), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id: (x.kept, x.char_distance) for x in o.quality(docs).collect()}
    assert all(kept[100 + i] == (True, 0.0) for i in range(3)) and not kept[200][0]
    assert {x.doc_id for x in o.keep_good(docs).collect()} == {d for d, (k, _) in kept.items() if k}


def _histograms(text):
    """The character classes (ten, without continuation bytes) and the common words of a text, by definition."""
    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\v\f\r", ".,;:?'\"-()", "#*$%&|<>", "!"]
    chars, words = Counter(), Counter()
    for c in text:
        chars["outside" if ord(c) > 127 else next((g for g in groups if c in g), "other")] += 1
    common = set(o.COMMON_WORDS)
    for w in text.encode().split():
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in w).decode()
        words[low if low in common else None] += 1
    return chars, words


def _distance(a, b):
    p, q = ({k: v / sum(x.values()) for k, v in x.items()} for x in (a, b))
    total = 0.0
    for k in set(p) | set(q):
        m = (p.get(k, 0) + q.get(k, 0)) / 2
        total += sum(x[k] * math.log2(x[k] / m) / 2 for x in (p, q) if x.get(k))
    return math.sqrt(max(total, 0))


def test_kept_equals_brute_force(spark):
    r = random.Random(11)
    vocabulary = {"en": "the of and river stone walks Morning, light. to be".split(), "fr": "de la le rivière pierre marche matin, lumière. et".split(), "xx": "the sky 12 Cloud! was".split()}

    def text(lang):
        n = r.choice([3, 25, 60, 200, 500])
        noise = r.choice([0, 0, 0, 0.05, 0.3, 0.9])
        return " ".join("".join(r.choice("XQ#%9!Z") for _ in range(4)) if r.random() < noise else r.choice(vocabulary[lang]) + (str(i) if r.random() < 0.3 else "") for i in range(n))

    rows = [(i, text(lang), lang if r.random() < 0.9 else r.choice(["en", "fr", None, "rare"])) for i in range(250) for lang in [r.choice(["en", "en", "fr", "xx"])]]
    got = {x.doc_id: x.kept for x in o.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}

    own = {d: _histograms(t) for d, t, _ in rows}

    def far(d, lang, references):
        if lang is not None and lang not in references:
            return False
        sides = []
        for k, least in ((0, o.MIN_CHARS), (1, o.MIN_WORDS)):
            n = sum(own[d][k].values())
            sides.append(min(_distance(own[d][k], references[x][k]) for x in references) if n >= least else 0)
        return sides[0] + sides[1] / 2 > o.LIMIT + o.SHORT / math.sqrt(max(1, sum(own[d][0].values())))

    def references(earlier):
        out = {}
        for d, _, lang in rows:
            if lang is not None and not (earlier is not None and far(d, lang, earlier)):
                a, b = out.setdefault(lang, (Counter(), Counter()))
                a.update(own[d][0])
                b.update(own[d][1])
        return {k: x for k, x in out.items() if sum(x[1].values()) >= o.REFERENCE_WORDS}

    last = references(references(None))
    want = {d: not brute(t)[5] and not far(d, lang, last) for d, t, lang in rows}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert {x.doc_id for x in o.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {d for d, k in want.items() if k}


def test_a_text_is_compared_with_every_reference(spark, monkeypatch):
    r = random.Random(4)
    langs = [f"l{i:02}" for i in range(45)]
    letters = {x: [chr(0x61 + i % 26) * (1 + i // 26) + c for c in "aeiouXYZ019,;#|"] for i, x in enumerate(langs)}
    text = lambda x: " ".join(r.choice(letters[x][:3] if x < "l20" else letters[x][4:9] if x < "l40" else letters[x][10:]) for _ in range(300))
    # fewer texts of later languages: those of the last ones are the rarest
    rows = [(100 * i + j, text(x), x) for i, x in enumerate(langs) for j in range(50 - i)]
    # labelled as the largest language, though of the rarest one
    rows += [(9000 + j, text("l44"), "l00") for j in range(3)] + [(9100, text("l44"), None), (9200, text("l44"), "unknown")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wanted = {x.doc_id: (x.char_distance, x.word_distance, x.kept) for x in o.quality(docs).collect()}
    assert wanted[9200][:2] == (0.0, 0.0)
    assert all(wanted[9000 + j][0] < 0.1 for j in range(3))
    # the same in chunks that a task reads again for each block
    monkeypatch.setattr(o, "CHUNK", 7)
    profiles = o.materialize(o.profile(docs), "profiles")
    references = o._references(profiles, o._references(profiles, None))
    assert sum(len(names) for names, _, _ in references) == 45 and references.held is None
    assert all(len(names) <= 7 for names, _, _ in references)
    own = profiles.toPandas()
    matrix = lambda c: np.array(own[c].tolist(), np.int64)
    by_char, by_word, _ = o._far(matrix("chars"), matrix("words"), o.pa.array(own["lang"], o.pa.string()), references)
    got = dict(zip(own["doc_id"], zip(by_char, by_word, strict=True), strict=True))
    assert all(np.allclose(got[d], wanted[d][:2]) for d in got)
