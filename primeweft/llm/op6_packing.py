"""Best-fit packing by the linear grouping scheme.

A document's ids (its tokens and an end id) are cut into pieces of at most
``capacity``; pieces are packed into sequences of ``capacity`` ids.

Plan, on the driver, from the histogram of piece lengths alone, which has
``capacity`` entries at most whatever the number of documents:

1. Pieces over ``small`` ids are sorted by length and cut into ``groups`` groups
   of equal cardinality; each length is rounded up to its group's largest.
2. Which configurations (multisets of the few rounded sizes) are used how often is
   optimised by a linear programme over all of them, solved by column generation;
   its whole parts are taken, and the rest, a few sequences for each size at most, is
   packed by best fit.
3. Actual pieces replace the rounded ones; sequences with the same actual
   lengths form runs, so that the plan stays as small as the histogram.
4. Small pieces, the largest first, go by best fit into what the runs leave.

Placement, on the executors: the rank of a piece among those of its length gives
its sequence and offset by arithmetic on the plan (`PLAN_ROWS`).

Null and empty texts have the end id alone.  Repeated rows are packed each.
Ties (equal lengths) are ranked by partition and order in it.  An empty table
gives no rows.
A very long text is a block of its own, handled whole by one task. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import bisect
import itertools
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, blocks, map_arrow, materialize, same_spans, span_hashes, text_bytes, word_spans

CAPACITY = 4096
#: Pieces of at most this many ids are packed by best fit.
SMALL = 1024
#: Groups of equal cardinality of the linear grouping.
GROUPS = 24
#: Words a worker remembers (a memory bound only).
REMEMBERED = 2_000_000


# ---------------------------------------------------------------- the plan
def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded length, [(length, count)]) of groups of near equal cardinality, from the largest length down."""
    total = sum(counts.values())
    out: list[tuple[int, list[tuple[int, int]]]] = []
    share, room = -(-total // groups) if total else 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = share
            take = min(left, room)
            out[-1][1].append((length, take))
            left -= take
            room -= take
    return out


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes of most worth within the capacity, built size by size in layers of one piece more each."""
    value, chosen = np.zeros(capacity + 1), []
    useful = [i for i in range(len(sizes)) if worth[i] > 1e-12]
    for _ in range(capacity // min(sizes)):
        more, pick = value.copy(), np.full(capacity + 1, -1)
        for i in useful:
            s = sizes[i]
            with_it = value[: capacity + 1 - s] + worth[i]
            better = with_it > more[s:] + 1e-12
            more[s:][better] = with_it[better]
            pick[s:][better] = i
        if (pick < 0).all():
            break
        chosen.append(pick)
        value = more
    out = np.zeros(len(sizes))
    room = capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            out[pick[room]] += 1
            room -= sizes[pick[room]]
    return out, float(value[capacity])


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, sizes) that use up the (size, count) pairs in nearly as few sequences as can be.

    The linear programme over all configurations is solved by column generation: the
    simplex method, whose next column is the configuration of most worth at the
    current prices.  Its whole parts are taken; what they leave over, a few sequences
    for each size at most, is packed by best fit, the largest first.
    """
    if not groups:
        return []
    left: dict[int, int] = defaultdict(int)
    for size, count in groups:
        left[size] += count
    sizes = sorted(left, reverse=True)
    need = np.array([left[s] for s in sizes], float)
    basis = np.diag([float(capacity // s) for s in sizes])  # a configuration a column
    times = need / np.diag(basis)
    for _ in range(50 * len(sizes) + 1000):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column, worth = best_configuration(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        steps = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(steps.argmin())
        basis[:, leaves] = column
        times = np.maximum(np.linalg.solve(basis, need), 0)
    out = []
    for j in range(len(sizes)):
        n = int(times[j] + 1e-6)
        each = basis[:, j].astype(int)
        n = min([n, *(left[s] // k for s, k in zip(sizes, each.tolist(), strict=True) if k)])
        if n:
            out.append((n, [s for s, k in zip(sizes, each.tolist(), strict=True) for _ in range(k)]))
            for s, k in zip(sizes, each.tolist(), strict=True):
                left[s] -= n * k
    rooms: list[tuple[int, int]] = []  # what is left in a sequence, and its number
    bins: list[list[int]] = []
    for s in sizes:
        for _ in range(left[s]):
            k = bisect.bisect_left(rooms, (s, -1))
            if k == len(rooms):
                bins.append([])
                rooms.append((capacity, len(bins) - 1))
            room, b = rooms.pop(k)
            bins[b].append(s)
            bisect.insort(rooms, (room - s, b))
    alike: dict[tuple[int, ...], int] = defaultdict(int)
    for b in bins:
        alike[tuple(b)] += 1
    return out + [(n, list(b)) for b, n in alike.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """(rows of length, first rank, count, first sequence, offset; number of sequences).

    Piece number r of a length lies in the row with the largest first rank up to r,
    in sequence (first sequence + r - first rank).
    """
    rows: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)  # pieces placed so far, by length
    made = 0
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by what is left: (first sequence, count)

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        rows.append((length, used[length], count, sequence, offset))
        used[length] += count

    large = {n: c for n, c in counts.items() if n > small and c}
    grouped = linear_groups(large, groups)
    queues: dict[int, list[list[int]]] = defaultdict(list)  # by rounded size: [length, count] still to place
    for size, members in grouped:
        queues[size] += [list(m) for m in members]
    for times, sizes in configurations([(size, sum(c for _, c in members)) for size, members in grouped], capacity):
        slots = []
        for size in sizes:
            need, parts = times, []
            while need:
                head = queues[size][0]
                take = min(need, head[1])
                parts.append((head[0], take))
                head[1] -= take
                need -= take
                if not head[1]:
                    queues[size].pop(0)
            slots.append(parts)
        cuts = sorted({0, times} | {c for parts in slots for c in np.cumsum([n for _, n in parts]).tolist()})
        at = [[0, 0] for _ in slots]  # part, sequences it has served
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for k, parts in enumerate(slots):
                if at[k][1] == parts[at[k][0]][1]:
                    at[k] = [at[k][0] + 1, 0]
                length = parts[at[k][0]][0]
                at[k][1] += b - a
                place(length, b - a, made + a, offset)
                offset += length
            runs[capacity - offset].append((made + a, b - a))
        made += times
    rest = sorted(r for r in runs if r)
    for length in sorted((n for n in counts if n <= small and counts[n]), reverse=True):
        todo = counts[length]
        while todo:
            k = bisect.bisect_left(rest, length)
            if k == len(rest):
                new = -(-todo // (capacity // length))
                runs[capacity].append((made, new))
                made += new
                bisect.insort(rest, capacity)
                continue
            room = rest[k]
            first, count = runs[room].pop()
            take = min(count, todo)
            place(length, take, first, capacity - room)
            if take < count:
                runs[room].append((first + take, count - take))
            if not runs[room]:
                rest.pop(k)
            if room - length:
                if not runs[room - length]:
                    bisect.insort(rest, room - length)
                runs[room - length].append((first, take))
            todo -= take
    return np.array(sorted(rows), np.int64).reshape(-1, 5), made


# ---------------------------------------------------------------- the documents
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LATIN = np.zeros(256, bool)  # second bytes of the letters U+00C0 to U+00FF, after the byte 0xC3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?|")] = True
#: The character that byte-level vocabularies show for each byte: printable ones are themselves, the others follow 255 in order.
_SHOWN = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
_SHOWN |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): the words of each text, A-Z lower-cased, with a cut between a letter and punctuation behind it.

    The vocabulary's normaliser and pattern do both anyway, so that ids stay the same.
    """
    low = LOWER[data]
    letter = _LETTER[low]
    letter[1:] |= _LATIN[low[1:]] & (low[:-1] == 0xC3)
    at = np.flatnonzero(letter[:-1] & _PUNCTUATION[low[1:]]) + 1
    starts, ends, _ = word_spans(low, np.union1d(offsets, at))
    return low, starts, ends, np.searchsorted(starts, offsets)


class Words:
    """The ids of words, remembered by the words' 64-bit hashes in sorted arrays.

    Words of ASCII and Latin-1 letters are the same after the normaliser but for
    their case and aren't cut; they go to the merges directly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.loaded = Tokenizer.from_file(path)
        self.literals = [t.content.encode() for t in self.loaded.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.spelled, self.places, self.lengths = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encoded(self, words: list[bytes]) -> list[list[int]]:
        merge, out, whole = self.merge, [], []
        for w in words:
            if w.isalpha():
                shown = w.decode()
            else:
                s = w.decode("utf-8", "replace")
                if not s.isalpha() or max(s) > "\xff":
                    whole.append((len(out), s))
                    out.append([])
                    continue
                shown = s.lower().encode().decode("latin-1").translate(_SHOWN)
            out.append([t.id for t in merge(shown)])
        for a in range(0, len(whole), 20_000):
            some = whole[a : a + 20_000]
            for (i, _), e in zip(some, self.tokenizer.encode_batch_fast([s for _, s in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _learn(self, new: np.ndarray, at: np.ndarray, hashes: np.ndarray, words: list[bytes]) -> None:
        ids = self.encoded(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate((self.pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes.sum()))))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        places = len(self.spelled) + np.cumsum(lengths) - lengths
        self.spelled = np.concatenate((self.spelled, np.frombuffer(b"".join(words), np.uint8)))
        self.hashes, self.starts, self.sizes, self.places, self.lengths = (np.insert(old, at[new], x) for old, x in ((self.hashes, hashes[new]), (self.starts, starts), (self.sizes, sizes), (self.places, places), (self.lengths, lengths)))

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start in them, number of ids) of each word; a remembered word is compared byte by byte with what was asked for."""
        values, shown, word = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, values)
        known = np.zeros(len(values), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == values[inside]
        new = np.flatnonzero(~known)
        if len(new) + len(self.hashes) > REMEMBERED and len(self.hashes):
            self.forget()
            return self.find(low, starts, ends)
        if len(new):
            raw = low.tobytes()
            self._learn(new, at, values, [raw[a:b] for a, b in zip(starts[shown[new]].tolist(), ends[shown[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, values)
        at, size = at[word], ends - starts
        pool, begin, count = self.pool, self.starts[at], self.sizes[at]
        same = self.lengths[at] == size
        same[same] = same_spans(low, starts[same], self.spelled, self.places[at[same]], size[same])
        if not same.all():  # another word of the same hash
            odd = np.flatnonzero(~same)
            ids = self.encoded([low[a:b].tobytes() for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
            begin, count = begin.copy(), count.copy()
            count[odd] = [len(x) for x in ids]
            begin[odd] = len(pool) + np.cumsum(count[odd]) - count[odd]
            pool = np.concatenate((pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count[odd].sum()))))
        return pool, begin, count


_LOADED: dict[str, Words] = {}


def _with_literals(data: np.ndarray, offsets: np.ndarray, literals: list[bytes]) -> list[int]:
    """Texts that hold the literal of an added token."""
    raw, found = data.tobytes(), set()
    for x in literals:
        at = raw.find(x)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(x) <= offsets[d + 1]:
                found.add(d)
            at = raw.find(x, at + 1)
    return sorted(found)


def ids_of(data: np.ndarray, offsets: np.ndarray, path: str, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the ids of text d are ids[first[d]:first[d + 1]], with ``end`` behind each.

    The vocabulary drops white space and never merges across it, so a text's ids
    are those of its words one after the other.  A text that holds an added token's
    literal goes to the tokenizer as a whole.
    """
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    memory = _LOADED[path]
    low, starts, ends, first = cut_words(data, offsets)
    pool, at, n = memory.find(low, starts, ends)
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    ids = pool[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
    first = before[first]
    if special := _with_literals(data, offsets, memory.literals):
        parts = [ids[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        for d in special:
            text = data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
            parts[d] = np.array(memory.loaded.encode(text, add_special_tokens=False).ids, np.uint32)
        ids = np.concatenate(parts)
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in parts])))
    if end is None:
        return ids, first
    return np.insert(ids, first[1:], np.uint32(end)), first + np.arange(len(first))


def cut_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, part, rank (of its length in its partition)."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches):
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, _, data, offsets in blocks(batch.column(1)):
                ids, first = ids_of(data, offsets, tokenizer, end_id)
                ids = ids.astype("<u4", copy=False)
                pieces = -(-np.diff(first) // capacity)
                d = np.repeat(np.arange(len(pieces)), pieces)
                piece = np.arange(len(d)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = first[d] + piece * capacity
                finish = np.minimum(begin + capacity, first[d + 1])
                length = finish - begin
                # the number of each piece among those of its length so far
                order = np.argsort(length, kind="stable")
                new = np.ones(len(order), bool)
                new[1:] = np.diff(length[order]) > 0
                run = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
                rank = np.empty(len(order), np.int64)
                rank[order] = run + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(ids.tobytes())
                own = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), finish.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(lo + d)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(np.full(len(d), part), pa.int32()), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([bytes(x) for x in own], pa.binary())] if keep_ids else []), names=[key, "piece", "start", "length", "ids_crc32", "part", "rank", *["ids"] * keep_ids])

    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * keep_ids
    return map_arrow(docs.select(key, text_bytes(text).alias("b")), cut, schema)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (length, part, rank, any more) with sequence_id and offset instead of part and rank.

    The pieces must be a written table: part and rank are read twice.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(histogram, capacity, small, groups)
    codes = spark.sparkContext.broadcast((rows[:, 0] << 40 | rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    names = [c for c in ranked.columns if c != "rank"]

    def assign(batches):
        starts, first, sequence, offset = codes.value
        for batch in batches:
            length = np.asarray(batch.column(names.index("length")), np.int64)
            rank = np.asarray(batch.column(len(names)), np.int64)
            at = np.searchsorted(starts, length << 40 | rank, "right") - 1
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    return map_arrow(ranked.select(*names, "rank"), assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document with its place: key, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = materialize(cut_documents(docs, tokenizer, key, text, end_id, capacity, keep_ids), "pieces")
    return place_pieces(pieces, capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary) of pieces packed with ``keep_ids``: at most ``capacity`` ids a row."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
