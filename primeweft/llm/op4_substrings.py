"""Substring dedup by level-wise doubling of word windows.

Level ``first`` (a quarter of the window): each window of twice as many words has,
among its windows of ``first`` words, one of least hash; equal windows have equal
ones.  Blocks exchange these and learn which occur more than once.  Only windows
whose shorter one is repeated are extended to twice the length; longer windows are
made of two survivors of half their length.  This goes on, doubling, from ``first``
words up to ``window``; where no candidates survive, nothing more is exchanged.  At
the last length each distinct window's first place (smallest id, then row, then
start) is found by an exchange of 128-bit hashes, and every other place of it is a
repeat.  Words covered by a repeat are removed.

Ids are whole numbers; other columns of ids are refused.  Null and empty texts have
no words.  Rows with equal ids are ordered by their place in the table, null ids come
first.  An empty table gives no rows.  A document is handled by one task, with about
50 bytes of memory for each byte of its text.
Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_of, map_arrow, span_hashes, window_hashes, window_places, word_spans
from .textblocks import answers_of, block_table, bucket_count, exchanged, opened, sent

WINDOW = 20


def sliding(x: np.ndarray, k: int, take: np.ufunc) -> np.ndarray:
    """take over each run of k values."""
    span = 1
    while 2 * span <= k:
        x = take(x[:-span], x[span:])
        span *= 2
    return take(x[: len(x) - (k - span)], x[k - span :]) if k > span else x


def repeated(owner: np.ndarray, hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """1 for hashes that two blocks hold, or one block more than once."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    out = many[order] > 0
    out[1:] |= same
    out[:-1] |= same
    # any place of the hash that is marked marks the others, which are neighbours
    back = np.empty(len(h), np.uint8)
    back[order] = out
    return back


def later(owner: np.ndarray, hashes: np.ndarray, second: np.ndarray, key: np.ndarray) -> np.ndarray:
    """1 for windows of which another block holds an earlier place."""
    order = np.lexsort((owner, key, second, hashes))
    h, s = hashes[order], second[order]
    out = np.zeros(len(h), np.uint8)
    out[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
    back = np.empty(len(h), np.uint8)
    back[order] = out
    return back


class Places:
    """Windows of a block, level by level."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, levels: list[int]):
        self.starts, self.ends, self.first = word_spans(data, offsets)
        self.n = len(self.starts)
        self.words = [span_hashes(data, self.starts, self.ends, seed) for seed in (0, 1)]
        self.document = doc_of(self.first)
        self.keys, self.levels = keys, levels

    def anchors(self) -> None:
        """The first level: sorted distinct least hashes, whether each has several places, and for each window its number."""
        half, window = self.levels[0], self.levels[1]
        h = window_hashes(self.words[0], half)
        valid = window_places(self.first, window, self.n)
        if not valid.any():
            self.hashes, self.many, self.of = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
            self.at = np.zeros(0, np.int64)
            return
        span = window - half + 1
        least = sliding(h, span, np.minimum)
        shown = np.concatenate((np.zeros(span - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(span - 1, np.uint64)))
        chosen = h[h == sliding(shown, span, np.maximum)]
        self.hashes, counts = np.unique(chosen, return_counts=True)
        self.many = (counts > 1).astype(np.uint8)
        self.at = np.flatnonzero(valid)
        self.of = np.searchsorted(self.hashes, least[self.at])

    def survive(self, answers: np.ndarray, level: int) -> None:
        """Keeps the windows of ``level`` words that are repeated and goes on to the next length."""
        alive = self.at[(answers[self.of] | self.many[self.of]) > 0]
        k = self.levels.index(level) + 1
        length = self.levels[k]
        if k > 1:  # both halves must have survived, in one document
            ok = np.zeros(self.n + 1, bool)
            ok[alive] = True
            alive = alive[alive + length <= self.n]
            alive = alive[ok[alive + level] & (self.document[alive] == self.document[np.minimum(alive + length, self.n) - 1])]
        self.at = alive
        both = [window_hashes(w, length, seed)[alive] for seed, w in enumerate(self.words)]
        d = self.document[alive]
        order = np.lexsort((alive, d, self.keys[d], both[1], both[0]))
        h, s = both[0][order], both[1][order]
        begin = np.ones(len(h), bool)
        begin[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(begin) - 1
        self.hashes, self.second, self.key = h[begin], s[begin], self.keys[d[order[begin]]]
        self.many = (np.bincount(group, minlength=len(self.hashes)) > 1).astype(np.uint8)
        self.of = np.empty(len(h), np.int64)
        self.of[order] = group
        self.is_first = np.empty(len(h), bool)
        self.is_first[order] = begin

    def removed(self, answers: np.ndarray) -> np.ndarray:
        """For each word, whether it is removed."""
        cover = np.zeros(self.n + 1, np.int64)
        at = self.at[~self.is_first | (answers[self.of] > 0)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.levels[-1], -1)
        return np.cumsum(cover)[: self.n] > 0


def doubling(first: int, window: int) -> list[int]:
    levels = [window]
    while levels[0] > first:
        if levels[0] % 2:
            raise ValueError("window must be first times a power of two")
        levels.insert(0, levels[0] // 2)
    if len(levels) < 2 or levels[0] != first:
        raise ValueError("window must be first times a power of two, two at least")
    return levels


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, first: int | None = None, texts: bool = False) -> DataFrame:
    """All columns but the text, and n_words, n_removed, kept_sha256; with ``texts`` also kept_text.

    kept_text is the text without the removed words and the white space after each.
    """
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must be a column of whole numbers")
    levels = doubling(first or (window // 4 if window % 4 == 0 else window // 2), window)
    others = [c for c in docs.columns if c != text]
    table = block_table(docs, text)
    n_buckets = bucket_count(table)
    names = [f"a{i}" for i in range(len(levels))]

    def places(batch, row: int, known: int) -> Places:
        keys = np.asarray(batch.column("extra")[row].values.field(others.index(key)).cast(pa.int64()).fill_null(-(1 << 63)), np.int64)
        p = Places(*opened(batch.column("offsets")[row].as_py(), batch.column("z")[row].as_py()), keys, levels)
        p.anchors()
        for i in range(known):
            p.survive(answers_of(p.hashes, n_buckets, batch.column(names[i])[row].as_py()), levels[i])
        return p

    def sender(known: int):
        def send(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    p = places(batch, row, known)
                    last = known == len(levels) - 1
                    yield sent(batch.column("block")[row].as_py(), p.hashes, [p.second, p.key] if last else [p.many], n_buckets)

        return send

    with_answers = table
    for i, _ in enumerate(levels):
        last = i == len(levels) - 1
        entries = map_arrow(with_answers, sender(i), "bucket long, block long, h binary" + (", v0 binary, v1 binary" if last else ", v0 binary"))
        answers = exchanged(entries, ["u8", "i8"] if last else ["u1"], later if last else repeated)
        answers = answers.withColumnRenamed("answers", names[i])
        with_answers = with_answers.join(answers.hint("shuffle_hash"), "block", "left")

    def keep(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                p = places(batch, row, len(levels) - 1)
                gone = p.removed(answers_of(p.hashes, n_buckets, batch.column(names[-1])[row].as_py()))
                data, offsets = opened(batch.column("offsets")[row].as_py(), batch.column("z")[row].as_py())
                raw = data.tobytes()
                stay = np.flatnonzero(~gone)
                words = [raw[a:b] for a, b in zip(p.starts[stay].tolist(), p.ends[stay].tolist(), strict=True)]
                cut = np.searchsorted(stay, p.first).tolist()
                shas = [hashlib.sha256(b" ".join(words[a:b])).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]
                total = np.diff(p.first)
                columns = [pa.array(total, pa.int64()), pa.array(total - np.diff(cut), pa.int64()), pa.array(shas, pa.string())]
                if texts:
                    columns.append(pa.array(_texts(raw, offsets, p, gone), pa.string()))
                extra = batch.column("extra")[row].values
                yield pa.RecordBatch.from_arrays([*[extra.field(i) for i in range(len(others))], *columns], names=[*others, "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others) + ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return map_arrow(with_answers, keep, schema)


def _texts(raw: bytes, offsets: np.ndarray, p: Places, gone: np.ndarray) -> list[str]:
    """The texts without removed words and the white space up to the next word."""
    out = []
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        lo, hi = int(p.first[d]), int(p.first[d + 1])
        if not gone[lo:hi].any():
            out.append(raw[a:b].decode("utf-8", "replace"))
            continue
        nexts = [*p.starts[lo + 1 : hi].tolist(), b]
        parts = [raw[a : p.starts[lo]]]
        parts += [raw[s:e] for s, e, g in zip(p.starts[lo:hi].tolist(), nexts, gone[lo:hi].tolist(), strict=True) if not g]
        out.append(b"".join(parts).decode("utf-8", "replace"))
    return out
