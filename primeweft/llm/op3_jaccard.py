"""N-gram Jaccard join by prefix trees.

Documents link when their sets of distinct shingles have a Jaccard similarity of
at least ``percent`` / 100; the result is the components of the links.

1. Shingles are ordered globally by the logarithm of the number of documents that
   have them (an exchange between blocks counts all of them), then by hash.  Two
   linked sets share one of their first ``n - ceil(t n) + 1`` shingles.  A document
   whose first shingles are all its own is linked with nothing.
2. Equal sets are one class, within a block before anything is shuffled.
3. The classes that have a shingle among their first ones are its list.  A class's
   best list is its longest; a list's anchor is the longest best list of its
   classes.  All lists of one anchor are joined together, so that a class is sent
   once for each anchor of its lists (a cluster of near copies has one), not once for
   each of its first shingles, and each list is whole in one place.
4. The sets of an anchor, frequent shingles first, are sorted into a trie.  One
   traversal carries all queries that can still link, shares the overlap counted so
   far between all sets below a node, and drops at a node the queries for which the
   remaining lengths can't reach the overlap needed.  Anchors of over ``TOGETHER``
   sets or ``CODES`` shingles are dealt into parts (see `_links`).
5. The components of the links found are those of all links.

Null and empty texts have an empty set and are linked with nothing.  A text of
fewer than ``k`` words is one shingle.  Repeated rows are equal sets.  A null id
never is a component's id unless all are null.  Ids of any type that can be ordered
will do.  An empty table gives no rows.  Hashes have 64 bits, but for the counts
that make the order, which 48 bits are enough for: a collision there changes the
order alone.
A very long text is a block of its own, handled whole by one task. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import LOWER, U64, doc_of, give_back, map_arrow, materialize, mix, span_hashes, window_hashes, window_places, word_spans
from .graph import components
from .textblocks import answers_of, block_table, bucket_count, exchanged, opened, sent

#: Sets of an anchor that one task joins, and their shingles.
TOGETHER = 4096
CODES = 1 << 21
#: Shingles whose overlap is counted before the bound is looked at again (a sum of bytes holds it).
PIECE = 64
#: Bytes of the matrix of the queries that a traversal carries.
MATRIX = 1 << 25
#: Bits of a hash by which documents are counted.
COUNTED = U64(0xFFFFFFFFFFFF0000)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingles of document d are hashes[first[d]:first[d + 1]]."""
    lowered = LOWER[data]
    starts, ends, first = word_spans(lowered, offsets)
    words = span_hashes(lowered, starts, ends)
    n = len(first) - 1
    count = np.diff(first)
    at = np.flatnonzero(window_places(first, k, len(words)))
    h = [window_hashes(words, k)[at]]
    d = [doc_of(first)[at]]
    for m in range(1, k):  # short texts are one shingle
        short = np.flatnonzero(count == m)
        if len(short):
            h.append(window_hashes(words, m)[first[short]])
            d.append(short)
    h, d = np.concatenate(h), np.concatenate(d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n + 1))


def digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that tell sets apart."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h ^ U64(seed)), dtype=U64)))
        out.append(sums[first[1:]] - sums[first[:-1]])
    return out[0], out[1]


def classes_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(d1, d2, first document of each class of equal sets, class of each document)."""
    a, b = digests(h, first)
    _, one, number = np.unique(np.stack((a, b, np.diff(first).astype(U64)), 1), axis=0, return_index=True, return_inverse=True)
    return a, b, one, number.reshape(-1)


def counted(h: np.ndarray, first: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes cut to the counted bits, documents with each, number of each shingle's): of equal sets one counts."""
    is_one = np.zeros(len(first) - 1, bool)
    is_one[one] = True
    values, number = np.unique(h & COUNTED, return_inverse=True)
    return values, np.bincount(number, is_one[doc_of(first)], minlength=len(values)).astype(np.int64), number


def rarity(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """0 for a hash that one document has, else 1 + floor(log2(documents))."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    begin = np.ones(len(h), bool)
    begin[1:] = h[1:] != h[:-1]
    group = np.cumsum(begin) - 1
    total = np.bincount(group, counts[order])
    kind = np.where(total < 2, 0, 1 + np.floor(np.log2(np.maximum(total, 1)))).astype(np.uint8)
    back = np.empty(len(h), np.uint8)
    back[order] = kind[group]
    return back


class Linked:
    """Components of what was linked, by labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: int, others: np.ndarray) -> None:
        own = self.label[i]
        found = np.unique(self.label[others])
        if len(found) > 1 or found[0] != own:
            self.label[np.isin(self.label, found)] = own


def _order(codes: np.ndarray, ranks: np.ndarray, side: np.ndarray | None, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each shingle, frequent ones first; whether more than one set, or both sides, have it)."""
    values, at, number, count = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
    shared = count > 1
    if side is not None:
        right = np.bincount(number, side[of], minlength=len(values))
        shared = (right > 0) & (right < count)
    place = np.empty(len(values), np.int64)
    place[np.lexsort((values, ranks[at]))[::-1]] = np.arange(len(values))
    return place[number], shared[number]


class Trie:
    """A trie over ascending sequences of numbers, as ranges of their sorted order."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, members: np.ndarray, sizes: np.ndarray):
        big = ids.astype(">u4")
        by = sorted(range(len(members)), key=lambda i: big[starts[i] : ends[i]].tobytes())
        self.ids, self.starts, self.ends, self.members, self.sizes = ids, starts[by], ends[by], members[by], sizes[by]
        self.lengths = self.ends - self.starts

    def common(self, lo: int, hi: int, depth: int) -> int:
        """The depth up to which the sequences lo to hi - 1 are the same."""
        a = self.ids[self.starts[lo] + depth : self.ends[lo]]
        if hi - lo == 1:
            return depth + len(a)
        b = self.ids[self.starts[hi - 1] + depth : self.ends[hi - 1]]
        m = min(len(a), len(b))
        differ = a[:m] != b[:m]
        return depth + (int(differ.argmax()) if differ.any() else m)

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[int, int]]:
        """Ranges of sequences longer than depth, by their next number."""
        if lo >= hi:
            return []
        following = self.ids[self.starts[lo:hi] + depth]
        cuts = np.flatnonzero(np.diff(following)) + lo + 1
        return list(zip([lo, *cuts.tolist()], [*cuts.tolist(), hi], strict=True))


class Queries:
    """Query sets carried through a trie together: which numbers each has and how many from each number on."""

    def __init__(self, ids: np.ndarray, of: np.ndarray, n: int, numbers: int):
        self.has = np.zeros((numbers, n), np.uint8)
        self.has[ids, of] = 1
        steps = -(-numbers // PIECE) + 1
        at = np.zeros((steps, n), np.int32)
        np.add.at(at, (ids // PIECE, of), 1)
        self.from_ = np.cumsum(at[::-1], 0, dtype=np.int32)[::-1]

    def overlap(self, piece: np.ndarray, active: np.ndarray) -> np.ndarray:
        if 4 * len(active) < self.has.shape[1]:
            return np.add.reduce(self.has[piece[:, None], active], 0, np.uint8)
        return np.add.reduce(self.has[piece], 0, np.uint8)[active]

    def left(self, number: int, active: np.ndarray) -> np.ndarray:
        """Numbers from ``number`` on, or a little more."""
        return self.from_[number // PIECE, active]


def _traverse(trie: Trie, queries: Queries, members: np.ndarray, sizes: np.ndarray, percent: int, ordered: bool, linked: Linked) -> None:
    """Links each query (a member and its set's size) with the trie's sets that are similar to it.

    ``ordered``: queries are the trie's own sets; a pair is looked at from its larger one.
    """
    t = percent
    stack = [(0, len(trie.members), 0, np.arange(len(members)), np.zeros(len(members), np.int64))]
    while stack:
        lo, hi, depth, active, overlap = stack.pop()
        least, largest, longest = int(trie.sizes[lo:hi].min()), int(trie.sizes[lo:hi].max()), int(trie.lengths[lo:hi].max())
        n = sizes[active]
        may = (t * n <= 100 * largest) & ((n >= least) if ordered else (100 * n >= t * least))
        end = trie.common(lo, hi, depth)
        segment = trie.ids[trie.starts[lo] + depth : trie.starts[lo] + end]
        active, overlap = active[may], overlap[may]
        for a in range(0, len(segment), PIECE):
            if not len(active):
                break
            piece = segment[a : a + PIECE]
            overlap = overlap + queries.overlap(piece, active)
            reach = np.minimum(queries.left(int(piece[-1]), active), longest - depth - a - len(piece))
            may = (100 + t) * (overlap + reach) >= t * (sizes[active] + least)
            if not may.all():
                active, overlap = active[may], overlap[may]
        if not len(active):
            continue
        while lo < hi and trie.lengths[lo] == end:
            s = int(trie.members[lo])
            hits = members[active[(100 + t) * overlap >= t * (sizes[active] + trie.sizes[lo])]]
            hits = hits[hits != s]
            if len(hits):
                linked.link(s, hits)
            lo += 1
        stack += [(a, b, end, active, overlap) for a, b in trie.children(lo, hi, end)]


def trie_join(sets: list[np.ndarray], ranks: list[np.ndarray], sizes: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """A label for each set: equal for sets in one component of the links.

    Of a set of ``sizes[i]`` shingles, ``sets[i]`` has those that other sets may have,
    with their ranks.  ``side``: for each set 0 or 1, if only links between sides are sought.
    """
    linked = Linked(len(sets))
    lengths = np.array([len(x) for x in sets])
    if len(sets) < 2 or not lengths.sum():
        return linked.label
    of = np.repeat(np.arange(len(sets)), lengths)
    ids, shared = _order(np.concatenate(sets), np.concatenate(ranks), side, of)
    ids, of = ids[shared], of[shared]
    enough = 100 * np.bincount(of, minlength=len(sets)) >= percent * sizes
    keep = enough[of]
    ids, of = ids[keep], of[keep]
    if not len(ids):
        return linked.label
    # numbers without gaps, ascending in each set
    ids = np.unique(ids, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, of))
    ids, of = ids[order], of[order]
    first = np.searchsorted(of, np.arange(len(sets) + 1))
    present = np.flatnonzero(np.diff(first))
    stored, asking = (present, present) if side is None else (present[side[present] == 0], present[side[present] == 1])
    if not len(stored) or not len(asking):
        return linked.label
    trie = Trie(ids, first[stored], first[stored + 1], stored, sizes[stored])
    numbers = int(ids.max()) + 1
    at_once = max(1, MATRIX // numbers)
    for a in range(0, len(asking), at_once):
        some = asking[a : a + at_once]
        parts = [ids[first[i] : first[i + 1]] for i in some]
        queries = Queries(np.concatenate(parts), np.repeat(np.arange(len(some)), [len(x) for x in parts]), len(some), numbers)
        _traverse(trie, queries, some, sizes[some], percent, side is None, linked)
    return linked.label


def _prepared(table: DataFrame, key: str, kind: str, k: int, percent: int) -> DataFrame:
    """A written table of the classes of each block of a table of blocks.

    (row, members (none, id, row), n, d1, d2, may), and for sets that may be linked
    codes and ranks (of the shingles that others have, rare ones first) and prefix.
    """
    n_buckets = bucket_count(table)

    def send(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                h, first = shingle_sets(*opened(batch.column("offsets")[row].as_py(), batch.column("z")[row].as_py()), k)
                values, documents, _ = counted(h, first, classes_of(h, first)[2])
                yield sent(batch.column("block")[row].as_py(), values, [documents.astype(np.int32)], n_buckets)

    answers = exchanged(map_arrow(table.select("block", "offsets", "z"), send, "bucket long, block long, h binary, v0 binary"), ["i4"], rarity)
    both = table.join(answers.hint("shuffle_hash"), "block", "left").select("block", "offsets", "z", "answers", F.col("extra").getField(key).alias("ids"))

    def order(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                h, first = shingle_sets(*opened(batch.column("offsets")[row].as_py(), batch.column("z")[row].as_py()), k)
                d1, d2, one, number = classes_of(h, first)
                values, _, at = counted(h, first, one)
                ranks = answers_of(values, n_buckets, batch.column("answers")[row].as_py())[at]
                n = np.diff(first)
                own = np.concatenate(([0], np.cumsum(ranks == 0)))
                alone = own[first[1:]] - own[first[:-1]]
                prefix = n + (-percent * n // 100) + 1
                codes, kinds, prefixes = [], [], []
                for d in one.tolist():
                    if n[d] and alone[d] < prefix[d]:
                        own_h, own_r = h[first[d] : first[d + 1]], ranks[first[d] : first[d + 1]]
                        some = np.argsort(own_r, kind="stable")[alone[d] :]  # hashes ascend already
                        codes.append(own_h[some].tobytes())
                        kinds.append(own_r[some].tobytes())
                        prefixes.append(own_h[some[: prefix[d] - alone[d]]].view(np.int64))
                    else:
                        codes.append(None)
                        kinds.append(None)
                        prefixes.append(None)
                rows = (batch.column("block")[row].as_py() << 22) + np.arange(len(n))
                by = np.argsort(number, kind="stable")
                ids = batch.column("ids")[row].values.take(pa.array(by))
                members = pa.StructArray.from_arrays([ids.is_null(), ids, pa.array(rows[by])], names=["none", "id", "row"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(one))))), pa.int32()), members)
                arrays = [pa.array(rows[one]), lists, pa.array(n[one], pa.int64()), pa.array(d1[one].view(np.int64)), pa.array(d2[one].view(np.int64)), pa.array([c is not None for c in codes], pa.bool_()), pa.array(codes, pa.binary()), pa.array(kinds, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "members", "n", "d1", "d2", "may", "codes", "ranks", "prefix"])

    schema = f"row long, members array<struct<none:boolean,id:{kind},row:long>>, n long, d1 long, d2 long, may boolean, codes binary, ranks binary, prefix array<long>"
    return materialize(map_arrow(both, order, schema), "sets")


def _joined(reps: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes found in each task of ``keyed`` (row, task, lo, hi, side).

    Sets are joined among themselves where lo = hi, else side 1 with side 0.
    """

    def join(table: pa.Table) -> pa.Table:
        within = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        names = table.column("v").combine_chunks()
        sets = [np.frombuffer(x, U64) for x in table.column("codes").to_pylist()]
        ranks = [np.frombuffer(x, np.uint8) for x in table.column("ranks").to_pylist()]
        sizes, side = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("n", "side"))
        label = trie_join(sets, ranks, sizes, percent, None if within else side)
        moved = np.flatnonzero(label != np.arange(len(label)))
        out = pa.table({"a": names.take(pa.array(moved)), "b": names.take(pa.array(label[moved]))})
        del sets, ranks, table
        give_back()
        return out

    ship(reps.sparkSession)
    # codes are shuffled once to meet their keys, once to their tasks
    full = reps.select("row", "v", "n", "codes", "ranks").join(keyed.hint("shuffle_hash"), "row")
    kind = reps.schema["v"].dataType.simpleString()
    return full.groupBy("task", "lo", "hi").applyInArrow(join, f"a {kind}, b {kind}").where("a != b")


def _links(reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the classes ``reps`` (row, v, n, codes, ranks, prefix) that have the components of all links.

    An anchor of up to ``TOGETHER`` sets is one task's.  A larger one is dealt into
    parts.  First each part is joined in itself and with part 0, work in proportion to
    the parts; a cohesive group then is one component, within which nothing is left to
    find.  Only sets outside of the largest such component meet the other parts.
    """
    index = reps.select("row", "n", F.explode("prefix").alias("code"))
    lists = index.groupBy("code").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    entries = index.join(lists, "code")
    best = entries.groupBy("row").agg(F.max(F.struct("c", "code")).alias("best"))
    anchors = entries.join(best, "row").groupBy("code").agg(F.max("best").alias("anchor"))
    seen = entries.join(anchors, "code").select("row", "n", F.col("anchor.code").alias("task")).distinct()
    seen = materialize(seen, "anchors")
    size = seen.groupBy("task").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).select("task", F.ceil(F.greatest(F.col("m") / TOGETHER, F.col("s") / CODES)).cast("int").alias("parts"))
    many = size.where("parts > 1")
    small = seen.join(many, "task", "left_anti").select("row", "task", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"))
    if many.isEmpty():
        return _joined(reps, small, percent)
    large = seen.join(many, "task").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    own = large.select("row", "task", F.col("part").alias("lo"), F.col("part").alias("hi"), F.lit(0).alias("side"))
    other = F.explode(F.when(F.col("part") == 0, F.sequence(F.lit(1), F.col("parts") - 1)).otherwise(F.array("part")))
    first = large.withColumn("hi", other).select("row", "task", F.lit(0).alias("lo"), "hi", (F.col("part") > 0).cast("int").alias("side"))
    found = materialize(_joined(reps, small.unionByName(own).unionByName(first), percent), "links")

    inner = components(found).select(F.col("a.row").alias("row"), F.col("root.row").alias("inner"))
    told = large.join(inner, "row", "left").withColumn("inner", F.coalesce("inner", "row"))
    counts = told.groupBy("task", "inner").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("task").agg(F.max(F.struct("k", F.col("inner").alias("main"))).alias("x")).select("task", F.col("x.main").alias("main"))
    rest = told.join(main, "task").where("inner != main")
    groups = rest.groupBy("task").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TOGETHER, F.sum("n") / CODES)).cast("int").alias("groups"))
    # part 0 has met all parts already
    sought = rest.join(groups, "task").where("part > 0").withColumn("lo", F.pmod(F.xxhash64("row", F.lit(1)), F.col("groups")).cast("int")).withColumn("hi", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)))
    against = large.where("part > 0").join(groups, "task").withColumn("hi", F.col("part")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    # numbers of parts below 0 and of groups from 0 never are equal: all these tasks join two sides
    columns = lambda df, side: df.select("row", "task", F.col("lo"), (-1 - F.col("hi")).alias("hi"), F.lit(side).alias("side"))
    second = _joined(reps, columns(sought, 1).unionByName(columns(against, 0)), percent)
    return found.unionByName(second)


def _rooted(table: DataFrame, key: str, kind: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes of blocks as of `_prepared`, classes (n, d1, d2, v, root)): v is the least member of a class, root that of its component."""
    sets = _prepared(table, key, kind, k, percent)
    classes = sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.array_min("members")).alias("v"), F.min(F.when(F.col("may"), F.col("row"))).alias("row"))
    reps = materialize(sets.select("row", "codes", "ranks", "prefix").join(classes.where("row is not null"), "row"), "classes")
    linked = components(_links(reps, percent)).select(F.col("a.row").alias("at"), "root")
    linked = reps.select("n", "d1", "d2", F.col("v.row").alias("at")).join(linked, "at").drop("at")
    return sets, materialize(classes.join(linked, ["n", "d1", "d2"], "left").select("n", "d1", "d2", "v", F.coalesce("root", "v").alias("root")), "roots")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable by links)."""
    table = block_table(docs.select(key, F.col(text).alias("text")))
    sets, roots = _rooted(table, key, docs.schema[key].dataType.simpleString(), k, percent)
    rooted = sets.select("n", "d1", "d2", "members").join(roots.select("n", "d1", "d2", "root"), ["n", "d1", "d2"], "left")
    each = rooted.select("n", "root", F.explode("members").alias("m"))
    component = F.when(F.col("root").isNull(), F.col("m.id")).otherwise(F.col("root.id"))
    return each.select(F.col("m.id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the smallest key stays, null last, then the first row."""
    others = [c for c in docs.columns if c != text]
    table = block_table(docs, text)
    sets, roots = _rooted(table, key, docs.schema[key].dataType.simpleString(), k, percent)
    empty = sets.where("n = 0").select(F.explode("members.row").alias("row"))
    kept_rows = roots.where("v.row = root.row").select("v.row").unionByName(empty)
    places = kept_rows.select(F.shiftright("row", 22).alias("block"), F.col("row").bitwiseAND(F.lit((1 << 22) - 1)).cast("int").alias("at"))
    stay = places.groupBy("block").agg(F.array_sort(F.collect_list("at")).alias("stay"))
    kept = table.join(stay.hint("shuffle_hash"), "block")
    names = docs.columns

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data, offsets = opened(batch.column("offsets")[row].as_py(), batch.column("z")[row].as_py())
                raw = data.tobytes()
                at = batch.column("stay")[row].as_py()
                extra = batch.column("extra")[row].values.take(pa.array(at, pa.int32()))
                own = pa.array([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in at], pa.string())
                yield pa.RecordBatch.from_arrays([own if c == text else extra.field(others.index(c)) for c in names], names=names)

    return map_arrow(kept, unpack, docs.schema)
