"""Language-model scoring with Brown class-based bigrams.

Training documents are those whose crc32 of the id as text, modulo ``folds``, is
not 0.  Tokens are words with A-Z lower-cased and one end for each document.

1. Counts of all training tokens.
2. The ``CLUSTERED`` most frequent words and the end are the *core*; every other
   word counts as its shape (last character, length, digits) for now.
3. Bigram counts of all training tokens over core words and shapes go to the
   driver, where exchange clustering moves words between ``CLASSES`` classes while
   the likelihood of the class bigrams grows.
4. Every other training word is exchanged too: the counts of its neighbours'
   classes are gathered by word, and it goes to the class in which the likelihood,
   against the broadcast table of step 3, is greatest.  Shapes are left to words
   that training doesn't have.
5. The class bigrams of the whole training text, with all words in their classes.
   Words seen once tell how often, and after which class, a new word of their shape
   comes (each counts once more for it).
6. A token's probability is that of its class after the previous token's class
   (additively smoothed towards the class's share) times that of the word in its
   class (0.1 added to each count; a new word is one of as many as its shape has
   words seen once, and one).

Words with a large count (``HEAD`` at most, none seen once) are looked up in a
broadcast table; the others' counts and classes come by a join on the word's hash,
with the places of the word in the document.

Words of equal counts are ordered by their bytes.  Null and empty texts have the end
alone, a null id counts as empty text.
Repeated rows are scored each.  Without training tokens the base score is that of
the formula with N = V = 0, and classes are equally likely.  An empty table gives
no rows.
A very long text is a block of its own, handled whole by one task. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, binary_views, blocks, doc_of, map_arrow, materialize, signed, span_hashes, text_bytes, word_spans

CLUSTERED = 768
CLASSES = 48
#: Rounds of exchanges over all clustered words; it ends before when nothing moves.
ROUNDS = 8
#: Words in the broadcast table at most.
HEAD = 1 << 17
ADDED = 0.1
#: Weight of the class's share in a transition probability.
TRANSITION = 2.0
#: Distinct words that a task counts before it hands the counts on (a memory bound only).
FLUSH = 500_000
#: Last characters, lengths and digits make 4 * 4 * 2 shapes.
SHAPES = 32


def held_out(key: str, folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0 to SHAPES - 1 for each word."""
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    tail = np.where((last == 46) | (last == 33) | (last == 63), 1, np.where((last == 44) | (last == 58) | (last == 59), 2, np.where((last >= 97) & (last <= 122), 0, 3)))
    size = np.searchsorted([4, 8, 14], ends - starts)
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    return tail * 8 + size * 2 + (digits[ends] > digits[starts])


def count_words(training: DataFrame) -> DataFrame:
    """(w, n): the count of each token; the end is the empty word."""

    def count(batches):
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])
            seen.clear()
            return out

        for batch in batches:
            seen[b""] += batch.num_rows
            for _, _, data, offsets in blocks(batch.column(0)):
                raw = LOWER[data].tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    seen.update(raw[a:b].split())
                if len(seen) > FLUSH:
                    yield rows()
        yield rows()

    return map_arrow(training.select("b"), count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


class Head:
    """Counts of frequent words by hash, and the numbers of the clustered ones."""

    def __init__(self, words: list[bytes], counts: list[int], clustered: int):
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        keys = span_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64((1 << 64) - 1))
        self.counts = np.append(np.array(counts, np.int64)[order], 0)
        self.symbols = np.append(np.where(order < clustered, order, -1), -1)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, symbol or -1) of each word."""
        found = span_hashes(data, starts, ends)
        at = np.searchsorted(self.keys, found)
        at = np.minimum(at, len(self.keys) - 1)
        hit = self.keys[at] == found
        return np.where(hit, self.counts[at], -1), np.where(hit, self.symbols[at], -1)

    @classmethod
    def of_classes(cls, keys: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> "Head":
        """A head whose symbols are classes."""
        head, order = cls([], [], 0), np.argsort(keys)
        head.keys = np.append(keys[order], np.uint64((1 << 64) - 1))
        head.counts, head.symbols = np.append(counts[order], -1), np.append(classes[order], -1)
        return head


def with_ends(values: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(values with the end after each document, the place of each document's first token)."""
    at = first[1:]
    return np.insert(values, at, end), first + np.arange(len(first))


def pair_counts(training: DataFrame, head, clustered: int) -> np.ndarray:
    """Counts of (previous symbol, symbol); symbols: clustered words, then shapes, then the end."""
    size = clustered + SHAPES + 1

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                lowered = LOWER[data]
                starts, ends, first = word_spans(lowered, offsets)
                _, symbol = head.value.find(lowered, starts, ends)
                symbol = np.where(symbol < 0, clustered + shapes(lowered, starts, ends), symbol)
                tokens, _ = with_ends(symbol, first, size - 1)
                before = np.concatenate(([size - 1], tokens[:-1]))  # the end before each document's first
                total += np.bincount(before * size + tokens, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    found = map_arrow(training.select("b"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # size * size rows at most
    out = np.zeros(size * size, np.int64)
    out[np.asarray(found.column("pair"))] = np.asarray(found.column("n"))
    return out.reshape(size, size)


def exchange(pairs: np.ndarray, clustered: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each symbol; clustered words get 0 to classes - 1, the others the numbers above.

    Words start dealt out by frequency; each in turn goes to the class in which the
    likelihood sum n(a, b) log n(a, b) - sum n(a) log n(a) - sum n(b) log n(b) is greatest.
    """
    size = len(pairs)
    classes = min(classes, clustered)
    of = np.concatenate((np.arange(clustered) % max(classes, 1), classes + np.arange(size - clustered)))
    n = classes + size - clustered
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    one = np.zeros((size, n))
    one[np.arange(size), of] = 1
    rows = pairs @ one  # from each symbol to each class
    columns = pairs.T @ one  # to each symbol from each class
    table = one.T @ rows
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            old, own = of[w], float(pairs[w, w])
            right, left = rows[w].copy(), columns[w].copy()
            right[old] -= own
            left[old] -= own
            # the table without w
            base = table.copy()
            base[old] -= right
            base[:, old] -= left
            base[old, old] -= own
            out_sum, in_sum = base.sum(1), base.sum(0)
            c = np.arange(classes)
            gain = (xlogx(base[:classes] + right) - xlogx(base[:classes])).sum(1) + (xlogx(base[:, :classes] + left[:, None]) - xlogx(base[:, :classes])).sum(0)
            # the class's own entry gets both and w's pairs with itself
            diagonal = base[c, c]
            gain += xlogx(diagonal + right[c] + left[c] + own) - xlogx(diagonal + right[c]) - xlogx(diagonal + left[c]) + xlogx(diagonal)
            gain -= xlogx(out_sum[:classes] + right.sum() + own) - xlogx(out_sum[:classes]) + xlogx(in_sum[:classes] + left.sum() + own) - xlogx(in_sum[:classes])
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                continue
            moved += 1
            of[w] = new
            base[new] += right
            base[:, new] += left
            base[new, new] += own
            table = base
            rows[:, old] -= pairs[:, w]
            rows[:, new] += pairs[:, w]
            columns[:, old] -= pairs[w]
            columns[:, new] += pairs[w]
        if not moved:
            break
    return of


def neighbours(training: DataFrame, head, of: np.ndarray, clustered: int) -> DataFrame:
    """(h, near): for each word outside of the core lists of codes (16 bits) and of how often it has them (32 bits).

    A code is the class before it, or the number of classes + the class behind it.  A
    task hands on a word's codes together.
    """
    n = int(of[-1]) + 1

    def combined(parts):
        h, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((code, h))
        h, code = h[order], code[order]
        word = np.concatenate(([True], h[1:] != h[:-1]))
        new = np.flatnonzero(word | np.concatenate(([True], code[1:] != code[:-1])))
        counts = np.diff(np.append(new, len(h))).astype(np.int32)
        words = np.flatnonzero(word)
        cuts = np.append(np.searchsorted(new, words), len(new))

        def packed(x: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((x.itemsize * cuts).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])

        return pa.RecordBatch.from_arrays([pa.array(signed(h[words])), packed(code[new]), packed(counts)], names=["h", "codes", "counts"])

    def count(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                lowered = LOWER[data]
                starts, ends, first = word_spans(lowered, offsets)
                _, symbol = head.value.find(lowered, starts, ends)
                far = np.flatnonzero(symbol < 0)
                symbol = np.where(symbol < 0, clustered + shapes(lowered, starts, ends), symbol)
                tokens, _ = with_ends(of[symbol], first, n - 1)
                at = far + doc_of(first)[far]
                if len(far):
                    h = span_hashes(lowered, starts[far], ends[far])
                    parts.append((np.concatenate((h, h)), np.concatenate((tokens[at - 1], n + tokens[(at + 1) % len(tokens)])).astype(np.uint16)))
                size += 2 * len(far)
                if size > 2 * FLUSH:
                    yield combined(parts)
                    parts, size = [], 0
        if parts:
            yield combined(parts)

    by = map_arrow(training.select("b"), count, "h long, codes binary, counts binary")
    return by.groupBy("h").agg(F.collect_list(F.struct("codes", "counts")).alias("near"))


class Gains:
    """What words add to the likelihood in each class, with the table of the classes as it is; those of small counts are looked up."""

    #: Counts whose gains are made beforehand: with a neighbour's class, of a word in all.
    FEW, SOME = 8, 64

    def __init__(self, table: np.ndarray, classes: int):
        self.size = len(table)
        self.both = np.concatenate((table[:, :classes], table[:classes].T))  # by code: before the class, behind it
        self.sums = np.stack((table[:, :classes].sum(0), table[:classes].sum(1)))
        self.pairs = np.stack([self._more(self.both, k) for k in range(self.FEW + 1)])
        self.wholes = np.stack([self._more(self.sums, k) for k in range(self.SOME + 1)])

    @staticmethod
    def _more(old: np.ndarray, n) -> np.ndarray:
        xlogx = lambda x: x * np.log(np.maximum(x, 1))
        return xlogx(old + n) - xlogx(old)

    def best(self, owner: np.ndarray, code: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
        """The best class of each word, as `exchange` has it; each has a code at least, some may have one repeatedly."""
        summed = np.bincount(owner * len(self.both) + code, n, words * len(self.both))
        at = np.flatnonzero(summed)
        n, code = summed[at], at % len(self.both)
        starts = np.searchsorted(at // len(self.both), np.arange(words))
        few = np.minimum(n, self.FEW).astype(np.int64)
        gain = self.pairs[few, code]
        many = np.flatnonzero(n > self.FEW)
        gain[many] = self._more(self.both[code[many]], n[many, None])
        gain = np.add.reduceat(gain, starts, 0)
        for side in (0, 1):
            own = np.add.reduceat(np.where(code // self.size == side, n, 0), starts)
            less = self.wholes[np.minimum(own, self.SOME).astype(np.int64), side]
            many = np.flatnonzero(own > self.SOME)
            less[many] = self._more(self.sums[side], own[many, None])
            gain -= less
        return gain.argmax(1)


def assigned(near: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """(h, class) of words with their neighbours' counts."""

    def assign(batches):
        gains = Gains(table, classes)
        for batch in batches:
            lists = batch.column(1)
            items = lists.flatten()
            raw, cuts = binary_views(items.field("codes"))
            code = np.frombuffer(raw[cuts[0] : cuts[-1]].tobytes(), np.uint16).astype(np.int64)
            # where each word's codes end
            ends = (cuts - cuts[0])[np.cumsum(np.asarray(lists.value_lengths(), np.int64))] // 2
            raw, cuts = binary_views(items.field("counts"))
            n = np.frombuffer(raw[cuts[0] : cuts[-1]].tobytes(), np.int32)
            owner = np.repeat(np.arange(len(lists)), np.diff(ends, prepend=0))
            out = np.zeros(len(lists), np.int32)
            for lo in range(0, len(lists), 2000):
                hi = min(lo + 2000, len(lists))
                a, b = (ends[lo - 1] if lo else 0), ends[hi - 1]
                out[lo:hi] = gains.best(owner[a:b] - lo, code[a:b], n[a:b], hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["h", "class"])

    return map_arrow(near, assign, "h long, class int")


class Model:
    """What scoring needs: tables of the classes, those of shapes and the end behind the others."""

    def __init__(self, of: np.ndarray, clustered: int, table: np.ndarray, inside: np.ndarray, members: np.ndarray, once: np.ndarray, core: np.ndarray, total: int, distinct: int, ends: int):
        self.of, self.clustered = of, clustered
        n, classes = len(table), len(inside)
        share = (table.sum(0) + 1) / (table.sum() + n)
        # for the end, what was before a document's first token is the end before it
        self.transition = np.log10((table + TRANSITION * n * share) / (table.sum(1, keepdims=True) + TRANSITION * n))
        #: the part of a word's probability in its class that is its class's alone
        self.within = np.concatenate((-np.log10(inside + ADDED * np.maximum(members, 1)), -np.log10(once + 1.0), [0.0]))
        self.emission = np.log10(core + ADDED) + self.within[of[:clustered]]  # of core words
        self.classes = classes
        self.base = float(np.log10(total + ADDED * (distinct + 1)))
        self.ends = ends
        self.total = total


def token_classes(rows: DataFrame, head, classes: int) -> DataFrame:
    """``rows`` (id, held_out, b) as a written table of tokens: row, id, held_out, known, logs, classes (a byte for each token) and rare.

    rare: (h, at) of each word outside of the head, with its places; such a word has the class of its shape.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(2)):
                n = hi - lo
                lowered = LOWER[data]
                starts, ends, first = word_spans(lowered, offsets)
                count, symbol = head.value.find(lowered, starts, ends)
                tokens, begin = with_ends(np.where(symbol < 0, classes + shapes(lowered, starts, ends), symbol), first, classes + SHAPES)
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[first])
                far, d = np.flatnonzero(count < 0), doc_of(first)
                h, of = span_hashes(lowered, starts[far], ends[far]), d[far]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                at = (far[order] - first[of]).astype(np.int32)
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))) if len(h) else np.zeros(0, np.int64)
                places = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((4 * np.append(new, len(h))).astype(np.int32).tobytes()), pa.py_buffer(at.tobytes())])
                items = pa.StructArray.from_arrays([pa.array(signed(h[new])), places], names=["h", "at"])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[new], np.arange(n + 1)).astype(np.int32)), items)
                text = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(begin[:n], len(tokens)).astype(np.int32).tobytes()), pa.py_buffer(tokens.astype(np.uint8).tobytes())])
                log = np.where(count >= 0, np.log10(np.maximum(count, 0) + ADDED), 0)
                ids = np.arange(number, number + n)
                number += n
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(sums(count > 0).astype(np.int64)), pa.array(sums(log).astype(float)), text, rare], names=["row", "id", "held_out", "known", "logs", "classes", "rare"])

    return materialize(map_arrow(rows.select("id", "held_out", "b"), cut, f"row long, id {kind}, held_out boolean, known long, logs double, classes binary, rare array<struct<h:long,at:binary>>"), "tokens")


def with_rare(tokens: DataFrame, words: DataFrame, classes: int) -> DataFrame:
    """``tokens`` with the counts and classes of ``words`` (h, n, class) in place of shapes, as a written table; once: (previous class * SHAPES + shape) of words seen once."""
    kind = tokens.schema["id"].dataType.simpleString()
    single = tokens.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.at").join(words, "h")
    far = single.groupBy("row").agg(F.collect_list(F.struct("n", "class", "at")).alias("far"))

    def fill(batches):
        for batch in batches:
            raw, offsets = binary_views(batch.column(5))
            flat = raw[offsets[0] : offsets[-1]].copy()
            offsets = offsets - offsets[0]
            lists = batch.column(6)
            sizes = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0), np.int64))
            items = lists.flatten()
            n, cls = np.asarray(items.field("n"), np.int64), np.asarray(items.field("class"), np.uint8)
            places, cuts = binary_views(items.field("at"))
            at = np.frombuffer(places[cuts[0] : cuts[-1]].tobytes(), np.int32)
            each = np.diff(cuts) // 4
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            target = np.repeat(offsets[doc], each) + at
            shape = flat[target].astype(np.int32) - classes
            flat[target] = np.repeat(cls, each)
            one = np.repeat(n, each) == 1
            before = np.where(at[one] > 0, flat[target[one] - 1], classes + SHAPES)
            owner = np.repeat(doc, each)[one]
            order = np.argsort(owner, kind="stable")
            codes = (before * SHAPES + shape[one]).astype(np.int32)[order]
            add = lambda x: np.bincount(doc, x, batch.num_rows)
            logs = np.asarray(batch.column(4)) + add(each * np.log10(n + ADDED))
            known = np.asarray(batch.column(3)) + add(each).astype(np.int64)
            text = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            once = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((4 * np.searchsorted(owner[order], np.arange(batch.num_rows + 1))).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(known), pa.array(logs), text, once], names=["id", "held_out", "known", "logs", "classes", "once"])

    joined = tokens.drop("rare").join(far, "row", "left").select("row", "id", "held_out", "known", "logs", "classes", "far")
    return materialize(map_arrow(joined, fill, f"id {kind}, held_out boolean, known long, logs double, classes binary, once binary"), "classes")


def class_bigrams(tokens: DataFrame, n: int) -> np.ndarray:
    """Counts of (previous class, class), with a word of its shape behind the class before each word seen once."""
    classes = n - 1 - SHAPES

    def count(batches):
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            raw, offsets = binary_views(batch.column(0))
            flat = raw[offsets[0] : offsets[-1]].astype(np.int64)
            total += np.bincount(np.concatenate(([n - 1], flat[:-1])) * n + flat, minlength=n * n)
            raw, offsets = binary_views(batch.column(1))
            code = np.frombuffer(raw[offsets[0] : offsets[-1]].tobytes(), np.int32).astype(np.int64)
            total += np.bincount(code // SHAPES * n + classes + code % SHAPES, minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    found = map_arrow(tokens.where(~F.col("held_out")).select("classes", "once"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # n * n rows at most
    out = np.zeros(n * n)
    out[np.asarray(found.column("pair"))] = np.asarray(found.column("n"))
    return out.reshape(n, n)


def fit(training: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, Model, int]:
    """(the tokens of ``rows`` (id, held_out, b), or of training, as a written table; the model; the least count of a head word)."""
    spark = training.sparkSession
    if rows is None:
        rows = training.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), "b")
    plain = count_words(training)

    def shape_of(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                starts, ends = offsets[:-1], offsets[1:]
                full = ends > starts
                shape = np.full(hi - lo, -1, np.int64)
                shape[full] = shapes(data, starts[full], ends[full])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(shape.astype(np.int32)), pa.array(signed(span_hashes(data, starts, ends)))], names=["w", "n", "shape", "h"])

    counts = materialize(map_arrow(plain, shape_of, "w binary, n long, shape int, h long"), "word-counts")
    # a histogram of counts in 16 steps for each doubling tells from which count on words fit the head
    step = F.floor(F.log2(F.col("n").cast("double")) * 16)
    total, distinct, ends = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("shape") < 0, F.col("n")))).first()
    kept, least = 0, 1 << 62
    for row in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("a")).orderBy(F.desc("s")).collect():  # 16 * 63 rows at most
        kept += row["k"]
        if kept > HEAD + 1:  # the end isn't one of the head
            break
        least = row["a"]
    words = counts.where("shape >= 0").select("w", "n")
    chosen = words.where(F.col("n") >= least).toArrow()  # HEAD rows at most
    if chosen.num_rows < CLUSTERED:  # very many words of one count: the core is the first of them
        chosen = words.orderBy(F.desc("n"), "w").limit(CLUSTERED).toArrow()
    pairs = sorted(zip(chosen.column("n").to_pylist(), chosen.column("w").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    clustered = min(CLUSTERED, len(pairs))
    head = Head([w for _, w in pairs], [n for n, _ in pairs], clustered)
    shared = spark.sparkContext.broadcast(head)
    table = pair_counts(training, shared, clustered)
    of = exchange(table, clustered, CLASSES)
    size = int(of[-1]) + 1
    classes = size - SHAPES - 1
    one = np.zeros((len(table), size))
    one[np.arange(len(table)), of] = 1
    core = np.flatnonzero(head.symbols >= 0)
    own = spark.createDataFrame(list(zip(signed(head.keys[core]).tolist(), of[head.symbols[core]].tolist(), strict=True)), "h long, class int")
    known = counts.where("shape >= 0").select("h", "n", "shape")
    if classes:
        found = assigned(neighbours(training, shared, of, clustered), one.T @ table @ one, classes).unionByName(own)
        words = materialize(known.join(found, "h"), "word-classes")
    else:  # no core: training has no words
        words = known.withColumn("class", F.col("shape"))
    inside, members, once = np.zeros(classes), np.zeros(classes), np.zeros(SHAPES)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect() if classes else []:  # a row for each class
        inside[r["class"]], members[r["class"]] = r["n"], r["k"]
    for r in words.where("n = 1").groupBy("shape").agg(F.count(F.lit(1)).alias("k")).collect():  # SHAPES rows
        once[r["shape"]] = r["k"]
    least = max(least, 2)
    many = words.where(F.col("n") >= least).select("h", "n", "class").toArrow()  # HEAD rows at most
    column = lambda c: np.asarray(many.column(c), np.int64)
    by_class = spark.sparkContext.broadcast(Head.of_classes(column("h").view(U64), column("n"), column("class")))
    tokens = with_rare(token_classes(rows, by_class, classes), words.where(F.col("n") < least).select("h", "n", "class"), classes)
    bigrams = class_bigrams(tokens, size)
    return tokens, Model(of, clustered, bigrams, inside, members, once, np.array([n for n, _ in pairs[:clustered]], float), total or 0, distinct or 0, ends or 0), least


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), held_out(key, folds).alias("held_out"), text_bytes(text).alias("b"))
    tokens, model, _ = fit(rows.where(~F.col("held_out")), rows)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(batches):
        m = shared.value
        for batch in batches:
            raw, offsets = binary_views(batch.column(4))
            flat = raw[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            n = np.diff(offsets)
            value = m.transition[np.concatenate(([m.classes + SHAPES], flat[:-1])), flat] + m.within[flat]
            known, logs = np.asarray(batch.column(2), np.int64), np.asarray(batch.column(3))
            base = logs + np.log10(m.ends + ADDED) + (n - 1 - known) * np.log10(ADDED) - n * m.base
            sums = np.diff(np.concatenate(([0], np.cumsum(value)))[offsets])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(known + (m.ends > 0)), pa.array(np.full(len(n), m.total, np.int64)), pa.array(base), pa.array(sums + logs)], names=names)

    return map_arrow(tokens.select("id", "held_out", "known", "logs", "classes"), score, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def is_held_out(key: int | None, folds: int = 10) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds == 0
