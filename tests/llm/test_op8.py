import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from primeweft.llm import common, op8_byte_bpe as o

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return o.coder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(bpe, text):
    return [i for x, _ in bpe.encode([text])[0] for i in np.frombuffer(x, np.int32).tolist()]


def brute(bpe, raw):
    """Merges the leftmost pair of least rank until none is left."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        ranks = [(bpe.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in bpe.ranks]
        if not ranks:
            return [bpe.ranks[p] for p in parts]
        _, i = min(ranks)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


TEXTS = ["", " ", "\n\n \t", "Hello world, it's 12345 o'clock!!", "naïve Ünïcödé ß 漢字 🎉🎉🏳️‍🌈", "aaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|>", "a\x00b\x1c\u2028c", "x" * 191, "x" * 192, "x" * 193, "ab" * 400, "é" * 300, "word " * 3000, "-" * 1000 + "=" * 999]


@pytest.mark.parametrize("seed", range(4))
def test_ids_equal_the_library(bpe, library, seed):
    r = random.Random(seed)
    chars = "aAbeEiost  \n.,'0123éßΣ漢字🎉-=_\t"
    texts = TEXTS + ["".join(r.choice(chars) for _ in range(r.randint(0, 400))) for _ in range(300)]
    bpe.encoded.clear()
    got = bpe.encode(texts)
    for text, pieces in zip(texts, got, strict=True):
        ids = [i for x, _ in pieces for i in np.frombuffer(x, np.int32).tolist()]
        assert ids == library.encode_ordinary(text), text
        assert b",".join(x for _, x in pieces) == ",".join(map(str, ids)).encode()
        assert bpe.decode(np.array(ids, np.int64)) == text.encode()


def test_matrices_and_heap_equal_brute_force(bpe):
    r = random.Random(8)
    pieces = [bytes(r.choice(b"etaoin sh\xc3\xa9") for _ in range(n)) for n in range(1, 230, 3) for _ in range(4)]
    for width in o.WIDTHS:
        own = [p for p in pieces if len(p) <= width]
        assert bpe.matrix(own, width) == [brute(bpe, p) for p in own]
    assert [bpe.long(p) for p in pieces] == [brute(bpe, p) for p in pieces]


def test_rows_of_a_bucket_are_padded(bpe, monkeypatch):
    seen = []
    matrix = bpe.matrix
    monkeypatch.setattr(bpe, "matrix", lambda raw, width: seen.append((width, {len(x) for x in raw})) or matrix(raw, width))
    bpe.encoded.clear()
    bpe.encode(["abcdefghijklmnopqrstuvwxyz"[:n] for n in range(1, 27)])
    assert (16, {13, 14, 15, 16}) in seen and all(max(n) <= w for w, n in seen) and len({w for w, _ in seen}) == len(seen)


def test_memory_bound_changes_nothing(bpe, monkeypatch):
    texts = [f"some words {i} and {i * 7919} more" for i in range(200)]
    want = [ids_of(bpe, t) for t in texts]
    monkeypatch.setattr(o, "REMEMBERED", 20)
    assert [ids_of(bpe, t) for t in texts] == want


def test_decoder_works_from_ids(bpe):
    assert o.decode_ids([], PATH, public_tokenizers.PATTERN) == b""
    r = random.Random(3)
    ids = [r.randrange(256) for _ in range(1000)]
    tokens = {v: k for k, v in bpe.ranks.items()}
    assert o.decode_ids(ids, PATH, public_tokenizers.PATTERN) == b"".join(tokens[i] for i in ids)
    for bad in (-1, bpe.size):
        with pytest.raises(ValueError):
            o.decode_ids([bad], PATH, public_tokenizers.PATTERN)


def test_documents(spark, library, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 5000)
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y", 2), (None, "no id", "x", 3), (99, None, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids long").repartition(3)
    got = o.encode_documents(docs, PATH, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted(((i, library.encode_ordinary(t or ""), t or "") for i, t, *_ in rows), key=str)
    for x, (i, ids, text) in zip(sorted(got, key=lambda x: str((x.doc_id, list(x.ids)))), want, strict=True):
        assert (x.doc_id, list(x.ids), x.n_tokens) == (i, ids, len(ids))
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert o.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
