"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are
compared with references of the languages by Jensen-Shannon distance (square
root of the divergence in bits).  References are sums over all documents of a
language, made anew once without the documents that were far from the first
ones.  A document is judged against the nearest of all references, so that a wrong
language label rejects nothing.  The references are a written table that each task
reads ``CHUNK`` rows at a time; however many languages there are, none is left out.

Minimum lengths guard the comparison: histograms of fewer than
``MIN_CHARS`` characters or ``MIN_WORDS`` words aren't judged.

Base rules, each over the whole text: n_words, word_chars, n_symbols,
n_dup_lines, n_repeat_words and base_failed (fewer than 20 words, or over 30 %
of the words in repeated 8-word windows).

Null and empty texts have no words and so fail the base rules.  Repeated rows
get equal results.  A null language has no reference of its own.  An empty table
gives no rows and needs no reference.  Texts of a language with fewer than
``REFERENCE_WORDS`` words in all have nothing to be compared with and are judged by the
base rules alone.
A very long text is handled whole by one task. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, blocks, doc_of, map_arrow, materialize, mix, span_hashes, text_bytes, window_hashes, window_places, word_spans, written
from .store import place

MIN_CHARS = 200
MIN_WORDS = 50
#: A document is kept if character distance + word distance / 2 is at most
#: LIMIT + SHORT / sqrt(characters): histograms of short texts scatter more.
LIMIT = 0.25
SHORT = 3.3
#: Words that a language's reference needs; references that a task holds at a time.
REFERENCE_WORDS = 1000
CHUNK = 1024
REPEAT_WINDOW = 8

#: Frequent function words of four languages.
COMMON_WORDS = """
the of and to in a is that for it as was with be by on not he this are at from or have an they which one you were her all their there been if more when will would who so
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux
der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
de la que el en y a los del se las por un para con no una su al lo como mas o pero sus le ha me si sin sobre este
""".split()
SYMBOLS = b"#*$%&|<>"

_CLASSES = np.zeros(256, np.int64)  # 0: other ASCII characters
for _n, _chars in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\v\f\r", b".,;:?'\"-()", SYMBOLS, b"!"), 1):
    _CLASSES[list(_chars)] = _n
_CLASSES[128:192] = 11  # continuation bytes, not counted
_CLASSES[192:] = 10  # characters outside ASCII
N_CLASSES = 11
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _lexicon() -> tuple[np.ndarray, int]:
    raw = list(dict.fromkeys(w.encode() for w in COMMON_WORDS))
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(span_hashes(data, ends - [len(w) for w in raw], ends)), len(raw)


def _repeats(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """For each word, whether a k-word window that covers it is found twice or more in its document."""
    n = len(words)
    covered = np.zeros(n + 1, np.int64)
    h = window_hashes(words, k)
    at = np.flatnonzero(window_places(first, k, n))
    if len(at):
        h = h[at] ^ mix(doc_of(first)[at].astype(U64) + U64(1))
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        begin = at[order[twice]]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + k, -1)
    return np.cumsum(covered)[:n] > 0


def _profiles(column: pa.Array):
    """(first row, rows, the five base counts, chars, words) of each block of a column of texts."""
    common, n_common = _lexicon()
    for lo, hi, data, offsets in blocks(column):
        n = hi - lo
        starts, ends, first = word_spans(data, offsets)
        total = lambda x, f: np.diff(np.concatenate(([0], np.cumsum(x)))[f])
        whole = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        length = whole[ends] - whole[starts]
        lowered = LOWER[data]
        exact = span_hashes(data, starts, ends)
        found = span_hashes(lowered, starts, ends)
        at = np.minimum(np.searchsorted(common, found), n_common - 1)
        at[common[at] != found] = n_common
        d = doc_of(first)
        words = np.bincount(d * (n_common + 1) + at, minlength=n * (n_common + 1)).reshape(n, -1)
        row = np.repeat(np.arange(n), np.diff(offsets))
        chars = np.bincount(row * (N_CLASSES + 1) + _CLASSES[data], minlength=n * (N_CLASSES + 1)).reshape(n, -1)[:, :N_CLASSES]
        raw = data.tobytes()
        duplicates = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
            duplicates.append(len(lines) - len(set(lines)))
        counts = [np.diff(first), total(length, first), total(_IS_SYMBOL[data], offsets), np.array(duplicates, np.int64), total(_repeats(exact, first, REPEAT_WINDOW), first)]
        yield lo, n, [c.astype(np.int64) for c in counts], chars, words


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, lang, the five base counts, and chars and words, the two histograms."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words"]

    def of(batches):
        for batch in batches:
            for lo, n, counts, chars, words in _profiles(batch.column(2)):
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.int32))) for x in (chars, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), *[pa.array(c) for c in counts], *lists], names=names)

    schema = f"`{key}` {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, words array<int>"
    return map_arrow(docs.select(key, F.col(lang).cast("string").alias("lang"), text_bytes(text).alias("b")), of, schema)


def distances(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to its nearest reference, in 0 to 1."""
    if not len(references):
        return np.zeros(len(counts))
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    best = np.full(len(counts), np.inf)
    entropy = lambda x: -np.sum(x * np.log2(np.where(x > 0, x, 1)), axis=1)
    for r in references:
        q = np.broadcast_to(r / max(r.sum(), 1), p.shape)
        best = np.minimum(best, entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2)
    return np.sqrt(np.maximum(best, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


class References:
    """The histograms of the languages, a written table: iterates over (names, characters, words) of at most ``CHUNK`` of them.

    A table of one chunk is read once in a task, a larger one once for each block of texts.
    """

    def __init__(self, path: str):
        self.path = path
        self.held: list | None = None

    def __iter__(self) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        if self.held is not None:
            yield from self.held
            return
        system, path = place(self.path)
        first, n = [], 0
        for batch in dataset.dataset(path, filesystem=system, format="parquet").to_batches(columns=["lang", "bins"], batch_size=CHUNK):
            if len(batch):
                bins = _matrix(batch.column(1))
                chunk = batch.column(0).to_pylist(), bins[:, :N_CLASSES], bins[:, N_CLASSES:]
                n += len(batch)
                first = [*first, chunk] if n <= CHUNK else []
                yield chunk
        if n <= CHUNK:
            self.held = first


def _references(profiles: DataFrame, earlier: References | None) -> References:
    """The references of the languages; rows far from ``earlier`` are left out."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            chars, words = _matrix(batch.column(1)), _matrix(batch.column(2))
            use = np.ones(len(chars), bool)
            if earlier is not None:
                use = ~_far(chars, words, batch.column(0), earlier)[2]
            labels = np.asarray(batch.column(0).to_pylist(), object)
            for lang in {x for x in labels.tolist() if x is not None}:
                mine = use & (labels == lang)
                total[lang] = total.get(lang, 0) + np.concatenate((chars[mine].sum(0), words[mine].sum(0)))
        rows = [(k, i, int(v)) for k, x in total.items() for i, v in enumerate(x.tolist()) if v]
        a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int64())], names=["lang", "bin", "n"])

    counts = map_arrow(profiles.select("lang", "chars", "words"), sums, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    by = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"), F.sum(F.when(F.col("bin") >= N_CLASSES, F.col("n"))).alias("total"))
    every = F.sequence(F.lit(0), F.lit(N_CLASSES + _lexicon()[1]))
    bins = F.transform(every, lambda i: F.coalesce(F.element_at("found", i), F.lit(0).cast("long")))
    return References(written(by.where(F.col("total") >= REFERENCE_WORDS).select("lang", bins.alias("bins")), "references")[1])


def _far(chars: np.ndarray, words: np.ndarray, langs: pa.Array, references: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character distance, word distance, beyond the limit), distances 0 where the text is too short or its language too rare to tell."""
    names = langs.to_pylist()
    open_names = {x for x in names if x is not None}
    known: set[str | None] = {None}
    long, many = chars.sum(1) >= MIN_CHARS, words.sum(1) >= MIN_WORDS
    by_char, by_word = np.full(len(chars), np.inf), np.full(len(words), np.inf)
    for found, ref_chars, ref_words in references:
        known |= open_names.intersection(found)
        by_char[long] = np.minimum(by_char[long], distances(chars[long], ref_chars))
        by_word[many] = np.minimum(by_word[many], distances(words[many], ref_words))
    judged = np.array([x in known for x in names], bool)
    by_char, by_word = (np.where(judged & np.isfinite(x), x, 0.0) for x in (by_char, by_word))
    return by_char, by_word, by_char + by_word / 2 > LIMIT + SHORT / np.sqrt(np.maximum(chars.sum(1), 1))


def _base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass all rules, with all their columns.

    A first pass gathers the references, a second one judges each text where it
    is, so that no text is shuffled.
    """
    profiles = materialize(profile(docs.select(F.lit(0).alias("none"), text, lang), "none", text, lang).select("lang", "chars", "words"), "profiles")
    references = _references(profiles, None)
    references = _references(profiles, references)
    at, name = docs.columns.index(text), docs.columns.index(lang)

    def keep(batches):
        for batch in batches:
            langs = batch.column(name).cast(pa.string())
            for lo, n, counts, chars, words in _profiles(batch.column(at)):
                good = ~_base_failed(counts[0], counts[4]) & ~_far(chars, words, langs.slice(lo, n), references)[2]
                yield batch.slice(lo, n).filter(pa.array(good))

    return map_arrow(docs, keep, docs.schema)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: key, base counts, base_failed, char_distance, word_distance, kept."""
    profiles = materialize(profile(docs, key, text, lang), "profiles")
    references = _references(profiles, None)
    references = _references(profiles, references)
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judge(batches):
        for batch in batches:
            by_char, by_word, far = _far(_matrix(batch.column(6)), _matrix(batch.column(7)), batch.column(8), references)
            n_words, repeats = (np.asarray(batch.column(i), np.int64) for i in (1, 5))
            failed = _base_failed(n_words, repeats)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(6)], pa.array(failed), pa.array(by_char), pa.array(by_word), pa.array(~failed & ~far)], names=[*names, "base_failed", "char_distance", "word_distance", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return map_arrow(profiles.select(*names, "chars", "words", "lang"), judge, schema)
