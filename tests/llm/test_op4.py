import hashlib
import random

import pytest
from primeweft.llm import textblocks
from primeweft.llm.op4_substrings import remove_repeats


def brute(rows, w):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = set()
        for s in range(len(words) - w + 1):
            x = tuple(words[s : s + w])
            if x in seen:
                gone.update(range(s, s + w))
            seen.add(x)
        kept = [x for j, x in enumerate(words) if j not in gone]
        out.append((rows[i][0], len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "first", "seed"), [(20, None, 1), (20, 5, 2), (4, None, 3), (8, 2, 4), (8, 1, 5)])
def test_against_brute_force(spark, monkeypatch, window, first, seed):
    monkeypatch.setattr(textblocks, "BLOCK", 4000)
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["É,", "ñ x"]
    text = lambda n: r.choice([" ", "\n", " \t"]).join(r.choice(pool) for _ in range(n))
    passages = [text(r.randint(window, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(160):
        parts = [r.choice([text(r.randint(0, 2 * window)), r.choice(passages)]) for _ in range(r.randint(0, 5))]
        rows.append((i, " ".join(parts), "k"))
    rows += [(200 + i, rows[3][1], "k") for i in range(40)] + [(300, None, "k"), (301, "", "k"), (302, "a " * 3000, "k"), (302, "a " * 30, "k"), (None, passages[0], "k"), (5, passages[1], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").coalesce(1)
    got = remove_repeats(docs.repartition(3) if seed != 1 else docs, window=window, first=first, texts=True).collect()
    if seed == 1:
        assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got), key=str) == brute(rows, window)
    else:  # the place in the table of the two rows with one id isn't known
        other = lambda rows: sorted((x for x in rows if x[0] not in (302, 5)), key=str)
        assert other((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in got) == other(brute(rows, window))
    assert all(hashlib.sha256(b" ".join(x.kept_text.encode().split())).hexdigest() == x.kept_sha256 and x.h == "k" for x in got)
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
