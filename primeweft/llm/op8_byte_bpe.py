"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

A text is cut by the pattern; pieces not seen before by the worker are put in
matrices, one for each bucket of lengths (``WIDTHS``), whose rows are padded to the
bucket's width.  In each round every row merges its leftmost pair of least rank, found
through a hashed table of pairs, and the matrix is compacted by one column; rows
without a pair leave.  Pieces of over ``LONG`` bytes take the same merges through a
heap, since a round for each merge over a whole long row would cost its square.
Decoding gathers the bytes of a text's ids from the vocabulary.

Null and empty texts have no tokens; repeated rows have equal results; every
text is encoded whole.  Bytes that aren't UTF-8 count as U+FFFD.  A null id stays,
an empty table gives no rows.
Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import blocks, map_arrow, text_bytes

#: Widths of the matrices; a row is padded to the next one.
WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192)
#: The longest piece in bytes that goes through matrices.
LONG = WIDTHS[-1]
#: What rows are padded with.
PAD = -1
#: Pieces a worker remembers; beyond that it starts anew (a memory bound only).
REMEMBERED = 400_000


class PairTable:
    """Open-addressed hash table from (left id, right id) to the merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, self.none, np.int64)
        key, rank = np.array(keys, np.int64), np.array(ids, np.int64)
        at = self.slot(key)
        while len(key):
            free = self.keys[at] < 0
            place, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[place], self.ids[place] = key[chosen], rank[chosen]
            left = np.ones(len(key), bool)
            left[chosen] = False
            key, rank, at = key[left], rank[left], (at[left] + 1) & (len(self.keys) - 1)

    #: The rank of a pair that can't be merged.
    none = 1 << 40

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32 | right).ravel()
        at = self.slot(key)
        found = self.keys[at]
        out = self.ids[at]
        out[found != key] = self.none
        open_ = np.flatnonzero((found != key) & (found >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.ids[at[hit]]
            more = ~hit & (found >= 0)
            open_, at = open_[more], at[more]
        return out.reshape(left.shape)


class ByteBpe:
    """Ranks of a ``.tiktoken`` file and a split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.table = PairTable(self.ranks)
        self.size = 1 + max(self.ranks.values())
        lengths = np.zeros(self.size, np.int64)
        for token, rank in self.ranks.items():
            lengths[rank] = len(token)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.spelled = np.frombuffer(b"".join(k for k, _ in sorted(self.ranks.items(), key=lambda x: x[1])), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: ids of a piece as little-endian 32-bit bytes, and in decimal joined by commas
        self.encoded: dict[str, tuple[bytes, bytes]] = {}

    def matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of at most ``width`` bytes."""
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        rows = np.full((len(pieces), width), PAD, np.int64)
        rows[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        place = np.arange(len(pieces))
        while len(place):
            if rows.shape[1] == 1:
                ranks = np.full((len(rows), 1), self.table.none, np.int64)
            else:
                right = rows[:, 1:]
                ranks = self.table.lookup(rows[:, :-1], np.maximum(right, 0))
                ranks[right == PAD] = self.table.none
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == self.table.none
            if done.any():
                for p, row in zip(place[done].tolist(), rows[done].tolist(), strict=True):
                    out[p] = [x for x in row if x != PAD]
                rows, place, at, best = rows[~done], place[~done], at[~done], best[~done]
                if not len(place):
                    break
            columns = np.arange(rows.shape[1] - 1)
            merged = np.take_along_axis(rows, columns[None, :] + (columns[None, :] > at[:, None]), 1)
            merged[np.arange(len(rows)), at] = best
            rows = merged
        return out

    def long(self, piece: bytes) -> list[int]:
        """Ids of one piece; the least rank first, the leftmost among equal ones."""
        ids: list[int] = self.single[np.frombuffer(piece, np.uint8)].tolist()
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, 1, 1) for i in range(len(ids) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, m, n = heapq.heappop(heap)
            j = after[i]
            if j < 0 or len(parts[i]) != m or len(parts[j]) != n:
                continue
            parts[i], ids[i] = parts[i] + parts[j], rank
            parts[j] = b""
            after[i] = after[j]
            after[j] = -1
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]), len(parts[b])))
        return [x for x, p in zip(ids, parts, strict=True) if p]

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that the worker hasn't seen."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode()
            n = len(raw)
            by_width.setdefault(WIDTHS[bisect.bisect_left(WIDTHS, n)] if n <= LONG else 0, []).append((p, raw))
        for width, group in by_width.items():
            step = max(1, (1 << 21) // max(width, 1))
            for a in range(0, len(group), step):
                some = group[a : a + step]
                raw = [r for _, r in some]
                for (p, _), row in zip(some, self.matrix(raw, width) if width else map(self.long, raw), strict=True):
                    self.encoded[p] = (array("i", row).tobytes(), b",".join(b"%d" % x for x in row))

    def encode(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """For each text its pieces' ids (see ``encoded``); new pieces of all texts fill the matrices together."""
        cut = [self.pattern.findall(x) for x in texts]
        new = {p for pieces in cut for p in pieces if p not in self.encoded}
        if len(self.encoded) + len(new) > REMEMBERED and self.encoded:
            self.encoded.clear()
            new = {p for pieces in cut for p in pieces}
        self.learn(new)
        return [list(map(self.encoded.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; one that the vocabulary doesn't have raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.lengths[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.spelled[np.repeat(self.starts[ids] - ends + n, n) + np.arange(n.sum())].tobytes()


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids`` the ids themselves.

    ``vocabulary`` is the path of the rank file on every executor.
    """
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches):
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for _, _, data, offsets in blocks(batch.column(1)):
                raw = data.tobytes()
                decoded = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                for pieces in bpe.encode(decoded):
                    ids = np.frombuffer(b"".join(x for x, _ in pieces), np.int32)
                    joined = b",".join(x for _, x in pieces)
                    rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), ids.tolist() if keep_ids else []))
            n, ids, back, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(key, text_bytes(text).alias("b")), encode, schema)


def decode_ids(ids: list[int], vocabulary: str, pattern: str) -> bytes:
    return coder(vocabulary, pattern).decode(np.array(ids, np.int64))
