import math
import random
from collections import Counter

import numpy as np
from primeweft.llm import op7_brown as o


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def test_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(o, "HEAD", 60)
    monkeypatch.setattr(o, "CLUSTERED", 30)
    monkeypatch.setattr(o, "CLASSES", 6)
    r = random.Random(3)
    names, verbs, ends = ["Dog%d" % i for i in range(60)], ["runs%d" % i for i in range(60)], ["here.", "there,", "ÉÀ", "x1"]
    sentence = lambda: f"the {r.choice(names)} {r.choice(verbs)} {r.choice(ends)}"
    rows = [(i, " ".join(sentence() for _ in range(r.randint(0, 30))), "x") for i in range(400)] + [(None, "the none", "x"), (500, None, "x"), (501, "", "x"), (3, "again", "x"), (900, "unseen1 words2 " * 50, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rare string")
    got = sorted(o.score_documents(docs).collect(), key=lambda x: (str(x.doc_id), x.n_tokens))
    c = Counter()
    for d, t, _ in rows:
        if not o.is_held_out(d):
            c.update([*lowered(t), b""])
    total, distinct = sum(c.values()), len(c)
    want = []
    for d, t, _ in rows:
        tokens = [*lowered(t), b""]
        want.append((d, o.is_held_out(d), len(tokens), sum(c[x] > 0 for x in tokens), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in tokens)))
    want.sort(key=lambda x: (str(x[0]), x[2]))
    for x, w in zip(got, want, strict=True):
        assert tuple(x)[:5] == w[:5] and abs(x.base_score - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert x.score < 0
    held = [x for x in got if x.held_out and x.doc_id != 900]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert o.score_documents(docs.limit(0)).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    kind = np.arange(40) // 10
    pairs = rng.poisson(np.where(kind[None, :] == (kind[:, None] + 1) % 4, 20.0, 0.2)).astype(np.int64)
    pairs = np.pad(pairs, (0, 3))

    def likelihood(of):
        one = np.eye(of.max() + 1)[of]
        t = one.T @ pairs @ one
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    start, found = o.exchange(pairs, 40, 5, rounds=0), o.exchange(pairs, 40, 5)
    assert likelihood(found) > likelihood(start)
    pure = o.exchange(pairs, 40, 4)
    assert likelihood(pure) >= likelihood(np.concatenate((kind, [4, 5, 6]))) - 1e-6


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a d. e " * (i % 5)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("cast(text as binary) b")
    _, m, _ = o.fit(docs)
    assert np.allclose((10**m.transition).sum(1), 1)
    for k in range(m.of[: m.clustered].max() + 1):
        assert abs(sum(10 ** m.emission[i] for i in range(m.clustered) if m.of[i] == k) - 1) < 1e-9


def test_words_outside_of_the_core_are_clustered_by_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(o, "HEAD", 40)
    monkeypatch.setattr(o, "CLUSTERED", 8)
    monkeypatch.setattr(o, "CLASSES", 8)
    r = random.Random(6)
    # a word after "a" is followed by "x", one after "b" by "y"; all have the same shape
    left, right = ["l%03d" % i for i in range(150)], ["r%03d" % i for i in range(150)]
    sentence = lambda: r.choice([f"a {r.choice(left)} x", f"b {r.choice(right)} y"])
    texts = [" ".join(sentence() for _ in range(30)) for _ in range(100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "false held_out", "cast(text as binary) b")
    tokens, m, _ = o.fit(rows, rows)
    kinds = {"l": Counter(), "r": Counter()}
    for row in tokens.select("id", "classes").collect():
        words = texts[row.id].split()
        assert len(row.classes) == len(words) + 1 and row.classes[-1] == m.classes + o.SHAPES
        for w, c in zip(words, row.classes, strict=False):
            if w[0] in kinds:
                kinds[w[0]][c] += 1
    assert all(c < m.classes for x in kinds.values() for c in x)
    (a, n), (b, k) = (x.most_common(1)[0] for x in kinds.values())
    assert a != b and n > 0.8 * sum(kinds["l"].values()) and k > 0.8 * sum(kinds["r"].values())


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(o, "HEAD", 25)
    monkeypatch.setattr(o, "CLUSTERED", 10)
    monkeypatch.setattr(o, "CLASSES", 4)
    r = random.Random(21)
    pool = [f"w{i % 7}x{i}." if i % 3 else f"Word{i}" for i in range(120)]
    rows = [(i, " ".join(r.choice(pool[: r.choice([5, 30, 120])]) for _ in range(r.randint(0, 25)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = docs.select(o.F.col("doc_id").alias("id"), o.held_out("doc_id").alias("held_out"), o.text_bytes("text").alias("b"))
    tokens, m, _ = o.fit(plain.where("not held_out"), plain)
    classes = {x.id: list(x.classes) for x in tokens.select("id", "classes").collect()}
    got = {x.doc_id: x.score for x in o.score_documents(docs).collect()}

    n_classes, end = m.classes, m.classes + o.SHAPES
    text = {d: lowered(t) for d, t in rows}
    training = [d for d in text if not o.is_held_out(d)]
    count = Counter(w for d in training for w in text[d])
    class_of = {w: c for d in training for w, c in zip(text[d], classes[d], strict=False)}
    assert all(c < n_classes for c in class_of.values())

    def shape(w):
        data = np.frombuffer(w, np.uint8)
        return int(o.shapes(data, np.array([0]), np.array([len(w)]))[0])

    table = Counter()
    for d in training:
        before = end
        for w, c in zip([*text[d], None], classes[d], strict=True):
            assert c == (end if w is None else class_of[w])
            table[before, c] += 1
            if w is not None and count[w] == 1:
                table[before, n_classes + shape(w)] += 1
            before = c
    size = end + 1
    row, column, total = Counter(), Counter(), sum(table.values())
    for (a, b), k in table.items():
        row[a] += k
        column[b] += k
    inside, members = Counter(), Counter()
    for w, c in class_of.items():
        inside[c] += count[w]
        members[c] += 1
    once = Counter(shape(w) for w in count if count[w] == 1)
    for d, words in text.items():
        want, before = 0.0, end
        for w in [*words, None]:
            c = end if w is None else class_of.get(w, n_classes + shape(w))
            share = (column[c] + 1) / (total + size)
            want += math.log10((table[before, c] + o.TRANSITION * size * share) / (row[before] + o.TRANSITION * size))
            if w is not None:
                want += math.log10((count[w] + o.ADDED) / (inside[c] + o.ADDED * members[c])) if w in class_of else -math.log10(once[c - n_classes] + 1)
            before = c
        assert abs(got[d] - want) < 1e-6, d


def test_words_of_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(o, "HEAD", 5)
    monkeypatch.setattr(o, "CLUSTERED", 6)
    monkeypatch.setattr(o, "CLASSES", 3)
    words = [f"w{i:02d}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(30)], "doc_id long, text string")
    tokens, m, _ = o.fit(docs.selectExpr("cast(text as binary) b"))
    assert m.classes == 3 and all(c < 3 for x in tokens.select("classes").collect() for c in list(x.classes)[:-1])
    got = o.score_documents(docs).collect()
    assert len(got) == 30 and all(np.isfinite(x.score) and x.n_known == 41 for x in got)


def test_gains_equal_their_definition():
    rng = np.random.default_rng(4)
    size, classes = 12, 5
    table = rng.poisson(6.0, (size, size)).astype(float)
    gains = o.Gains(table, classes)
    words = [[(int(c), float(rng.choice([1, 2, 7, 8, 9, 40, 300]))) for c in rng.choice(2 * size, rng.integers(1, 9), replace=False)] for _ in range(200)]
    # a count over one may come in two parts
    flat = [(i, c, part) for i, w in enumerate(words) for c, n in w for part in ([n] if n == 1 else [1.0, n - 1])]
    got = gains.best(*(np.array(x) for x in zip(*flat, strict=True)), len(words))
    f = lambda x: x * math.log(x) if x > 1 else 0.0
    for w, k in zip(words, got.tolist(), strict=True):
        value = []
        for c in range(classes):
            before = [(a, n) for a, n in w if a < size]
            behind = [(a - size, n) for a, n in w if a >= size]
            v = sum(f(table[a, c] + n) - f(table[a, c]) for a, n in before) + sum(f(table[c, a] + n) - f(table[c, a]) for a, n in behind)
            for side, total in ((before, table[:, c].sum()), (behind, table[c].sum())):
                v -= f(total + sum(n for _, n in side)) - f(total)
            value.append(v)
        assert value[k] >= max(value) - 1e-6
