import random
import zlib
from collections import defaultdict

from primeweft.llm.op1_shards import shard_rows, write_shards


def check(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 16
    want = sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((str(x.doc_id), x["size"], x.text_crc32) for x in got) == want
    slots, load, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for x in got:
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < shards
        slots[x.shard].append(x.slot)
        load[x.shard] += x["size"]
        where[x.text_crc32, x["size"]].add(x.shard)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(load.values()) / shards
    largest = max((n for _, n, _ in want), default=0)
    assert all(v <= 1.2 * mean + 2 * largest for v in load.values())
    return load, where, mean


def test_hot_group_is_split_and_small_groups_stay(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    hot, pair = text(300), text(200)
    rows = [(i, hot, 1) for i in range(1500)] + [(2000 + i, pair, 1) for i in range(2)] + [(3000 + i, text(r.randint(0, 900)), 1) for i in range(3000)] + [(None, None, 1), (None, "", 1), (7, hot, 1), (7, hot, 1)]
    got = shard_rows(spark.createDataFrame(rows, "doc_id long, text string, size int"), 8).collect()
    load, where, mean = check(rows, got, 8)
    assert max(load.values()) < 1.02 * mean and min(load.values()) > 0.98 * mean
    assert len(where[zlib.crc32(hot.encode()), len(hot.encode()) + 16]) >= 2
    assert len(where[zlib.crc32(pair.encode()), len(pair.encode()) + 16]) == 1


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    from primeweft.llm import op1_shards

    monkeypatch.setattr(op1_shards, "FINE", 2)
    monkeypatch.setattr(op1_shards, "ROWS", 50)
    seen = []
    located = op1_shards._located
    monkeypatch.setattr(op1_shards, "_located", lambda rows, bounds, *more: seen.append(len(bounds)) or located(rows, bounds, *more))
    rows = [(i, f"text {i * 7919}") for i in range(4000)]
    check(rows, shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), 4)
    assert min(seen) >= 70


def test_small_and_odd_tables(spark, tmp_path):
    for rows in ([], [(1, "a")], [(1, "same")] * 50, [(i, "x" * (10_000 if i == 3 else 3)) for i in range(60)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        check(rows, shard_rows(docs, 5).collect(), 5)
    write_shards(docs, shard_rows(docs, 5), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
