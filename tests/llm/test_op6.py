import random

import numpy as np
import public_tokenizers
import pytest
from primeweft.llm import op6_packing
from primeweft.llm.op6_packing import pack_documents, plan, sequences

def ids_of(raws, path):
    data = np.frombuffer(b"".join(raws), np.uint8)
    ids, first = op6_packing.ids_of(data, np.concatenate(([0], np.cumsum([len(x) for x in raws]))).astype(np.int64), path)
    return [ids[a:b].tobytes() for a, b in zip(first, first[1:])]


PATH = public_tokenizers.path("word_bpe_49k.json")


def spread_out(counts, capacity=4096, **more):
    rows, made = plan(counts, capacity, **more)
    fill = {}
    seen = {}
    for length, first, count, sequence, offset in rows.tolist():
        assert first == seen.get(length, 0)
        seen[length] = first + count
        for i in range(count):
            fill.setdefault(sequence + i, []).append((offset, length))
    assert seen == {k: v for k, v in counts.items() if v}
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) == made
    return made


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_each_piece_once(seed):
    r = random.Random(seed)
    counts = {}
    for _ in range(r.choice([0, 1, 5, 300, 3000])):
        n = r.choice([r.randint(1, 4096), r.randint(1, 600), 4096, 2048])
        counts[n] = counts.get(n, 0) + r.choice([1, 1, 1, 40])
    made = spread_out(counts)
    total = sum(k * v for k, v in counts.items())
    if sum(counts.values()) > 1000:
        assert made <= 1.03 * -(-total // 4096) + 2


def test_plan_small_capacity_against_bound():
    assert spread_out({6: 3, 4: 3}, 10, small=2) == 3
    assert spread_out({10: 5, 1: 10}, 10, small=2) == 6


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:k]:
                place(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_configurations_reach_the_optimum_of_small_instances(seed):
    r = random.Random(seed)
    sizes = r.sample(range(20, 61), 3)
    counts = [(s, r.randint(1, 4)) for s in sizes]
    made = op6_packing.configurations(counts, 100)
    used = {}
    for times, chosen in made:
        assert sum(chosen) <= 100
        for s in chosen:
            used[s] = used.get(s, 0) + times
    assert used == dict(counts)
    assert sum(t for t, _ in made) <= fewest([s for s, n in counts for _ in range(n)], 100) + 1


def test_configurations_reach_the_programme_bound():
    # 1000 of each: 6+4, 5+5 and 7+3 fill whole sequences
    made = op6_packing.configurations([(7, 1000), (6, 1000), (5, 1000), (4, 1000), (3, 1000)], 10)
    assert sum(t for t, _ in made) == 2500


def test_lengths_are_rounded_to_few_sizes():
    r = random.Random(4)
    counts = {}
    for _ in range(3000):
        n = r.randint(1025, 4096)
        counts[n] = counts.get(n, 0) + 1
    groups = op6_packing.linear_groups(counts, op6_packing.GROUPS)
    assert len(groups) == op6_packing.GROUPS < len(counts) / 20
    members = [sum(c for _, c in g) for _, g in groups]
    assert max(members) - members[-1] <= max(members) and len(set(members[:-1])) == 1
    assert all(n <= size for size, g in groups for n, _ in g)
    assert sum(c for size, g in groups for n, c in g if n < size) > 2500


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    for x in ["", "Hello  WORLD\n\t it's 12,5 É é ß Ω", "a b c\x1cd éf", " x<|endoftext|>y <b> 🎉🎉 漢字", "<|EndOfText|>", "A<|startoftext|><|endoftext|>", "<|endoftext|", "|>"]:
        assert np.frombuffer(ids_of([x.encode()], PATH)[0], "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_ids_of_random_words_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    r = random.Random(8)
    texts = ["".join(r.choice("aAbBéÉe\u0301ßΣςİıﬁ漢9 .,!?|;:'-<ÿÖ×÷ªµ¿…") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for x, ids in zip(texts, ids_of([x.encode() for x in texts], PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_literals_of_special_tokens_among_other_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ["one <|endoftext|> two", "", "plain words", "<|endof", "text|> cut by documents", "<|startoftext|>"]
    got = ids_of([x.encode() for x in texts], PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_one_hash(monkeypatch):
    from primeweft.llm import op6_packing
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    monkeypatch.setattr(op6_packing, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    monkeypatch.setattr(op6_packing, "_LOADED", {})
    for text in ("abc xyz hello abc world", "xyz abc world it's longerwords abcdefghi abcdefghj"):
        assert np.frombuffer(ids_of([text.encode()], PATH)[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pack_documents(spark):
    words = "alpha beta gamma delta 12 it's".split()
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 50, 900, 9000]))), "x") for i in range(60)] + [(60, None, "x"), (61, "", "x"), (5, "same id", "y"), (None, "no id", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack_documents(docs, PATH, keep_ids=True).cache()
    out = got.collect()
    by = {}
    for x in out:
        assert len(x.ids) == 4 * x.length
        by.setdefault(x.sequence_id, []).append(x)
    for parts in by.values():
        at = 0
        for x in sorted(parts, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 4096
    text = dict((a, b) for a, b, _ in rows if a not in (5, None))
    for d, t in text.items():
        mine = sorted((x for x in out if x.doc_id == d), key=lambda x: x.piece)
        assert b"".join(bytes(x.ids) for x in mine) == ids_of([(t or "").encode()], PATH)[0] + b"\1\0\0\0"
    assert sum(len(x.ids) for x in sequences(got).collect()) == sum(4 * x.length for x in out)
    assert pack_documents(docs.limit(0), PATH).count() == 0
