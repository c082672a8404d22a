import hashlib
import random
import zlib

import numpy as np
from primeweft.llm import op9_chunks as o


def test_gear_is_the_rolling_hash():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(o._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert o.gear(data).tolist() == want


def test_cuts_keep_bounds_and_follow_content():
    r = random.Random(1)
    a = bytes(r.randrange(256) for _ in range(60_000))
    ends = o.chunk_ends(a)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(a) and sizes[:-1].min() >= o.SHORTEST and sizes.max() <= o.LONGEST
    pieces = {a[i:j] for i, j in zip([0, *ends], ends, strict=False)}
    b = a[:100] + b"inserted" + a[100:]
    ends = o.chunk_ends(b)
    assert len({b[i:j] for i, j in zip([0, *ends], ends, strict=False)} - pieces) <= 3
    assert o.chunk_ends(bytes(20_000))[-1] == 20_000


def test_round_trip(spark):
    r = random.Random(4)
    shared = "".join(r.choice("abcdefgh é") for _ in range(30_000))
    rows = [(i, r.choice([None, "", "x" * 64, "y" * 63, shared, shared[: 500 * i], str(r.random()) * 400]), 1) for i in range(80)] + [(None, "null id", 1), (3, "again", 1), (3, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = o.media_documents(docs, media=True).collect()
    want = []
    for d, t, _ in rows:
        raw = (t or "").encode()
        p = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert o.samples(o.wav(p)) == p
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(x.media).hexdigest() == x.media_sha256 and len(x.media) == x.media_bytes for x in got)
    assert len({(x.payload_sha256, x.feature, x.media_sha256) for x in got}) == len({x.payload_sha256 for x in got})
    assert o.media_documents(docs.limit(0)).count() == 0


def test_feature_equals_brute_force():
    r = random.Random(9)
    for n in (1, 64, 640):
        payload = bytes(r.choice([0, 127, 128, 129, 200, 255]) for _ in range(n))
        x = [b - 128 for b in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert o.feature(payload) == f"sum={sum(x)};energy={sum(v * v for v in x)};crossings={crossings};values={len(set(payload))}"
