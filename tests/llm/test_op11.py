"""Winnowing against a plain version of its definition."""

import hashlib
import random

import pytest
from primeweft.llm.op11_winnowing import winnow


def murmur(data: bytes, seed: int = 42) -> int:
    """Spark's ``hash`` of binary data."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF

    def step(h, word):
        x = rot(word * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        return (rot(h ^ x, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = step(h, int.from_bytes(data[i : i + 4], "little"))
    for x in data[whole:]:
        h = step(h, (x - 256 if x > 127 else x) & 0xFFFFFFFF)
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def plain(text: str, k: int, w: int) -> list[tuple[int, int]]:
    data = text.encode()
    if not data:
        return []
    grams = [murmur(data[i : i + k]) for i in range(max(len(data) - k + 1, 1))]
    found = set()
    for j in range(max(len(grams) - w + 1, 1)):
        window = grams[j : j + w]
        least = min(window)
        found.add(j + max(i for i, x in enumerate(window) if x == least))
    return [(i, grams[i] & 0xFFFFFFFF) for i in sorted(found)]


def rows_of(docs: list[tuple], k: int, w: int) -> list[tuple]:
    """Expected rows of (id, text) with distinct ids."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda x: (x[0] is not None, x[0]))
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    shown = lambda f: " ".join(f"{i}:{h:08X}" for i, h in f)
    sets = lambda f: {h for _, h in f}
    out = []
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = plain(t, k, w), plain(edited, k, w), plain(after, k, w)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), like(sets(a), sets(b)), like(sets(a), sets(c))))
    return out


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    made = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    base = made(900, "abcdé ")
    out = ["", "x", "short text", "aaaa" * 60, "ab" * 75, made(31, "ab"), made(30, "abc"), made(46, "xyz"), base, base[:600] + made(200, "de \U0001f600"), base, made(2500, "ab€")]
    return out + [made(rng.randrange(200), "abcdefgh ") for _ in range(30)]


@pytest.mark.parametrize(("k", "w", "piece"), [(16, 16, 4096), (5, 4, 7), (3, 8, 1), (8, 2, 50)])
def test_equals_the_definition(spark, k, w, piece):
    docs = [(7 * i % 101 - 20, t) for i, t in enumerate(texts(k))] + [(1000, None), (None, "no id at all, but a text")]
    got = winnow(spark.createDataFrame(docs, "doc_id long, text string"), k, w, piece)
    found = {r["doc_id"]: tuple(r) for r in got.collect()}
    for want in rows_of(docs, k, w):
        assert found[want[0]][:5] == want[:5]
        assert found[want[0]][5:] == pytest.approx(want[5:])
    assert len(found) == len(docs)


def test_shared_passages_share_a_fingerprint(spark):
    rng = random.Random(3)
    k, w = 16, 16
    made = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [made(k + w - 1) for _ in range(40)]
    docs = [(2 * i + side, made(rng.randrange(300)) + p + made(rng.randrange(300))) for i, p in enumerate(passages) for side in (0, 1)]
    hashes = {r["doc_id"]: {x.partition(":")[2] for x in r["fingerprint"].split()} for r in winnow(spark.createDataFrame(docs, "doc_id long, text string"), k, w).collect()}
    assert all(hashes[2 * i] & hashes[2 * i + 1] for i in range(len(passages)))


def test_repeated_rows_ids_and_names(spark):
    t = "the same text in each of these rows, long enough for windows"
    rows = [(1, t, 5, "x")] * 3 + [(1, "another text under the same id, as long as the first one", 6, "y"), (2, t, 7, "z")]
    got = winnow(spark.createDataFrame(rows, "doc_id long, text string, bucket int, codes string")).collect()
    assert len(got) == 5 and len({r["fingerprint"] for r in got if r["n_chars"] == len(t)}) == 1
    assert sorted(r["near_next"] for r in got) != [0.0] * 5


def test_lone_row_and_empty_table(spark):
    one = winnow(spark.createDataFrame([(5, "abcdefgh" * 10)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert winnow(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_ranges_of_ids(spark):
    rng = random.Random(9)
    docs = [(rng.randrange(1 << 40) - (1 << 39), "".join(rng.choice("abc ") for _ in range(60))) for _ in range(700)]
    got = {r["doc_id"]: r["edited_sha256"] for r in winnow(spark.createDataFrame(docs, "doc_id long, text string").repartition(9)).collect()}
    assert got == {r[0]: r[2] for r in rows_of(docs, 16, 16)}


def test_a_very_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefg hij") for _ in range(120_000))
    docs = [(1, long), (2, "brief")]
    found = {r["doc_id"]: tuple(r) for r in winnow(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[1][:5] == rows_of(docs, 16, 16)[0][:5]
