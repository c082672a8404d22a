"""Words that polynomial hashes modulo 2^64 take for one another, in every operator that looks words up by hash."""

import numpy as np
import pytest
import public_tokenizers
from primeweft.llm.common import same_spans, span_hashes, window_hashes, word_spans

LENGTHS = [1024, 2048, 4096]


def turned(n: int, letters: str = "ab") -> tuple[str, str]:
    """The Thue-Morse word of two letters, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [2, 8, 9, 16, 64, 65, 128, *LENGTHS])
def test_hashes_of_words_and_windows_differ(n):
    data = np.frombuffer(" ".join(turned(n)).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    for seed in (0, 1):
        a, b = span_hashes(data, starts, ends, seed)
        assert a != b
        row = np.array([(a, b)[bin(i).count("1") % 2] for i in range(2 * n)], np.uint64)
        one, other = window_hashes(row, n, seed)[[0, n]] if n < 2049 else (0, 1)
        assert (one == other) == (row[:n].tolist() == row[n:].tolist())
    assert same_spans(data, starts, data, starts[::-1], ends - starts).tolist() == [False, False]


def test_zero_bytes_and_shifts_count():
    data = np.frombuffer(b"a a\0 a\0\0 12345678 12345678\0 8765432187654321 1234567812345678 8123456781234567", np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    assert len(set(span_hashes(data, starts, ends).tolist())) == len(starts)
    assert same_spans(data, starts, data, starts, ends - starts).all()


@pytest.mark.parametrize("n", LENGTHS)
def test_components(spark, n):
    from primeweft.llm.op3_jaccard import jaccard_components

    a, b = turned(n)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"), k=4, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("n", LENGTHS)
def test_repeated_passages(spark, n):
    from primeweft.llm.op4_substrings import remove_repeats

    a, b = turned(n)
    around = [f"w{i}" for i in range(19)]
    docs = [(1, " ".join([*around[:9], a, *around[9:]])), (2, " ".join([*around[:9], b, *around[9:]]))]
    got = {r["doc_id"]: r["n_removed"] for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}


@pytest.mark.parametrize("n", LENGTHS)
def test_repeated_windows_in_a_text(spark, n):
    from primeweft.llm.op2_quality import quality

    a, b = turned(n)
    seven = "one two three four five six seven"
    docs = [(1, f"{seven} {a} {seven} {b}", "en"), (2, f"{seven} {a} {seven} {a}", "en")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got == {1: 0, 2: 16}


@pytest.mark.parametrize("n", LENGTHS)
def test_ids(n):
    from primeweft.llm.op6_packing import ids_of
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = list(turned(n))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, first = ids_of(data, np.array([0, n, 2 * n]), path)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_known_words(spark):
    from primeweft.llm.op7_brown import is_held_out, score_documents

    a, b = turned(1024)
    out = next(i for i in range(1000) if is_held_out(i))
    training = [i for i in range(1000) if not is_held_out(i)][:3]
    docs = [(i, f"{a} some words") for i in training] + [(out, f"{b} some words")]
    got = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[out] == (4, 3) and got[training[0]] == (4, 4)
