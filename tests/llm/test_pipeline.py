import random
from collections import Counter

import corpus_pipeline as c
import public_tokenizers
from primeweft.llm.op2_quality import quality
from tokenizers import Tokenizer


def words(text):
    return (text or "").encode().split()


def near(docs):
    """Ids that stay, by brute force over pairs."""
    s = {}
    for d, t, *_ in docs:
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()).split()
        s[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in s}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if find(d) == d}


def repeats(docs):
    seen, out = set(), {}
    for d, t, *_ in sorted(docs):
        w = words(t)
        gone = set()
        for s in range(len(w) - 19):
            x = tuple(w[s : s + 20])
            if x in seen:
                gone.update(range(s, s + 20))
            seen.add(x)
        out[d] = [x for j, x in enumerate(w) if j not in gone]
    return out


def test_stages_against_brute_force(spark):
    r = random.Random(1)
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(c.COLUMNS)
    rows = [tuple(x) for x in frame.collect()]
    rows += [(10_000 + i, " ".join(w if r.random() > 0.01 else "changed" for w in rows[i][1].split(" ")), *rows[i][2:]) for i in range(20)]
    rows += [(20_000, None, None, None, None), (20_001, "", "en", "s", 0), (20_002, rows[7][1] + "\n" + rows[9][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, frame.schema).repartition(3)
    kept = {x.doc_id for x in quality(docs).collect() if x.kept}
    one = c.quality_rules(spark, docs, "").cache()
    assert one.columns == c.COLUMNS and {x.doc_id for x in one.collect()} == kept and len(kept) == one.count()
    assert Counter(tuple(x) for x in one.collect()) == Counter(x for x in rows if x[0] in kept)
    two = c.near_duplicates(spark, one, "").cache()
    first = [tuple(x) for x in one.collect()]
    want = near(first)
    assert Counter(tuple(x) for x in two.collect()) == Counter(x for x in first if x[0] in want)
    three = c.repeated_passages(spark, two, "").cache()
    assert three.columns == c.COLUMNS
    assert {x.doc_id: words(x.text) for x in three.collect()} == repeats([tuple(x) for x in two.collect()])
    assert all(x.n_chars == len(x.text) for x in three.collect())
    four = c.packing(spark, three, "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for x in three.collect():
        mine = [p for p in four if p.doc_id == x.doc_id]
        assert sum(p.length for p in mine) == len(tokenizer.encode(x.text, add_special_tokens=False).ids) + 1
    fill = Counter()
    for p in four:
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 4096


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    text = " ".join(f"the word{i} of this and" for i in range(30))
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (None, text, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(x) for x in c.near_duplicates(spark, docs, "").collect()] == rows[:1]
    now = docs.limit(0)
    for i, (_, stage) in enumerate(c.STAGES):
        now = stage(spark, now, "")
        now.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        assert now.count() == 0


def test_run(spark):
    got = c.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100
