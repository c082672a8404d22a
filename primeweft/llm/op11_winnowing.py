"""Document fingerprints by winnowing, in DataFrame functions alone.

Every k-gram of the UTF-8 bytes of a text is hashed; of each window of w following
k-grams the one of least hash is chosen, the rightmost of equals, and its position is
kept.  Two texts that share a passage of ``k + w - 1`` bytes so share a fingerprint of
it: the passage holds a whole window, whose choice depends on the window alone.

A text is cut into pieces of some thousand windows.  A piece's hashes are an array, and
each of its windows is a row inside generated code, kept where the choice changes: the
entering hash is not above the others, or the one that left was below them.  The few
kept rows are gathered again; rows stay in the partition that has their text.

The edited text shares its beginning with the text: choices of windows that lie in it
are taken over, and only the windows that reach into the new end are judged.

The next document by id comes by one exchange: ranges of ids, whose bounds are the
least ids of Spark's own range partitions, with the first row of each range also sent to
the range before (that of the first range to the last one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a k-gram and k-grams of a window.
K, W = 16, 16
#: Windows of a piece.
PIECE = 1 << 12
_LOW = 0xFFFFFFFF


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed, or copied out of its row, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(data: Column, begin: Column, kind: int, k: int, w: int, piece: int) -> Column:
    """Pieces of the windows of binary ``data``, whose first byte is at ``begin``.

    Each but the first begins one k-gram early, for the choice before its own first one.
    A text without a whole window is one piece; an empty one has none.
    """
    windows = F.greatest(F.octet_length(data) - F.lit(k + w - 2), F.lit(1))

    def cut(s: Column) -> Column:
        early = F.when(s > 0, F.lit(1)).otherwise(F.lit(0))
        return F.struct(F.lit(kind).alias("kind"), early.alias("early"), (begin + s - early).cast("bigint").alias("base"), F.substring(data, s + 1 - early, early + F.lit(piece + k + w - 2)).alias("part"))

    starts = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), windows - 1, F.lit(piece)))
    return F.coalesce(F.transform(starts, cut), F.array().cast("array<struct<kind:int,early:int,base:bigint,part:binary>>"))


def _chosen(pieces: DataFrame, keys: list[str], k: int, w: int) -> DataFrame:
    """(keys, kind, window, code): the choices of the pieces, each with the first window that makes it.

    ``code`` is the position, and the hash in the low 32 bits.  A row without a part gives one row without a code.
    """
    grams = F.sequence(F.lit(1), F.greatest(F.octet_length("part") - F.lit(k - 1), F.lit(1)))
    hashed = pieces.select(*keys, "kind", "early", "base", _let(F.col("part"), lambda part: F.transform(grams, lambda i: F.hash(F.substring(part, i, F.lit(k))))).alias("h"))
    rows = hashed.select(*keys, "kind", "base", "h", F.explode_outer(F.sequence(F.col("early"), F.greatest(F.size("h") - F.lit(w), F.lit(0)))).alias("j"))
    h, j = F.col("h"), F.col("j")
    inner = F.array_min(F.slice(h, j + 1, F.lit(w - 1)))
    before, after = F.get(h, j - 1), F.get(h, j + F.lit(w - 1))
    changed = rows.where(j.isNull() | (j == 0) | F.when(after <= before, after <= inner).otherwise(before < inner))
    window = F.slice(h, j + 1, F.lit(w))
    placed = changed.select(*keys, "kind", (F.col("base") + j).alias("window"), window.alias("x"), F.array_min(window).alias("m"))
    at = F.col("window") + F.size("x") - F.array_position(F.reverse(F.col("x")), F.col("m"))
    code = F.shiftleft(at.cast("bigint"), 32).bitwiseOR(F.col("m").cast("bigint").bitwiseAND(F.lit(_LOW)))
    return placed.select(*keys, "kind", "window", code.alias("code"))


def text_of(codes: Column) -> Column:
    """``position:hash`` (decimal, 8 hexadecimal digits) of each code, by position, with a space between."""
    return F.array_join(F.transform(codes, lambda x: F.concat(F.shiftrightunsigned(x, 32).cast("string"), F.lit(":"), F.substring(F.hex(x.bitwiseOR(F.lit(1 << 62))), 9, 8))), " ")


def hashes_of(codes: Column) -> Column:
    """The distinct hashes of an array of codes."""
    return F.array_distinct(F.transform(codes, lambda x: x.bitwiseAND(F.lit(_LOW))))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct hashes; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _bucket(order: Column, bounds: list[int]) -> Column:
    """Number of the range that holds a value: that of the last bound not above it."""
    top = 1 << max(len(bounds) - 1, 0).bit_length()
    places = F.lit([*bounds, *[(1 << 63) - 1] * (top - len(bounds))]) if top > 1 else None
    if places is None:
        return F.lit(0)
    steps = F.array(*[F.lit(top >> (i + 1)) for i in range(top.bit_length() - 1)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(places, at + s) <= order, at + s).otherwise(at))
    return F.least(found, F.lit(len(bounds) - 1))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, t) with the columns ``bucket``, ``order``, ``tie`` and ``ghost``, dealt by ranges of ids.

    Ghosts are copies of the first rows of the next range, at the end of each range.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = docs.select(order.alias("o")).repartitionByRange(n, "o").groupBy(F.spark_partition_id().alias("p")).agg(F.min("o").alias("o"))
    bounds = sorted(r["o"] for r in ranged.select("o").collect()) or [0]
    own = _bucket(F.col("order"), bounds)
    keyed = docs.select("*", order.alias("order"), F.xxhash64("t").alias("tie")).withColumn("own", own)
    first = F.get(F.lit(bounds), F.col("own")) == F.col("order")
    before = F.pmod(F.col("own") - 1, F.lit(len(bounds)))
    places = F.when(first, F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost")), F.struct(before.alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ghost"))))
    dealt = keyed.select("doc_id", "t", "order", "tie", F.inline_outer(places))
    return dealt.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "bucket")


def winnow(docs: DataFrame, k: int = K, w: int = W, piece: int = PIECE) -> DataFrame:
    """Fingerprints of (doc_id, text), of the edited texts, and their likeness.

    The edited text of a document is the text without its last floor(n_chars / 4) code
    points, followed by the first as many (or all) of the next document's.  The next one is
    that of the next larger id, after the last the first; a lone row is its own next.
    Likeness is the shared share of the distinct hashes.

    A text without a whole window has its least k-gram as fingerprint, one without a k-gram
    itself, an empty or null one "" and likeness 1 to an empty one, else 0.  Rows of one id
    follow each other by a hash of their texts; null ids come first.  Equal rows each have a
    row of their own.  A very long text is handled in pieces with the same result; its
    positions are bytes up to 2^31.  An empty table gives no rows.  Other columns, whatever
    their names, are left out.
    """
    if min(k, w) < 2:
        raise ValueError("k-grams and windows have at least 2 members")
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    ordered = Window.partitionBy("bucket").orderBy("ghost", "order", "tie")
    both = with_next(base).select("bucket", "ghost", "doc_id", "t", F.lead("t").over(ordered).alias("next"), F.row_number().over(ordered).alias("row"))
    n = F.char_length("t")
    cut = F.floor(n / 4).cast("int")
    kept = both.select("bucket", "row", "ghost", "doc_id", "t", n.cast("bigint").alias("n_chars"), F.left(F.col("t"), n - cut).alias("kept"), F.when(F.col("ghost"), F.lit("")).otherwise(F.left(F.col("next"), cut)).alias("end"))
    edited = kept.select("bucket", "row", "ghost", "doc_id", "n_chars", F.col("t").cast("binary").alias("data"), F.concat("kept", "end").cast("binary").alias("edited"), F.octet_length("kept").alias("b"))
    begin = F.greatest(F.col("b") - F.lit(k + w - 2), F.lit(0))
    own = _pieces(F.col("data"), F.lit(0), 0, k, w, piece)
    rest = F.substring("edited", begin + 1, F.octet_length("edited"))
    new = F.when(F.col("ghost") | ((begin > 0) & (F.octet_length("edited") - begin < k + w - 1)), F.array().cast("array<struct<kind:int,early:int,base:bigint,part:binary>>")).otherwise(_let(rest, lambda x: _pieces(x, begin, 1, k, w, piece)))
    facts = F.struct("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("sha"), "ghost").alias("facts")
    none = F.array(F.struct(F.lit(2).alias("kind"), F.lit(0).alias("early"), F.lit(0).cast("bigint").alias("base"), F.lit(None).cast("binary").alias("part")))
    cuts = edited.select("bucket", "row", "b", facts, F.concat(none, own, new).alias("pieces")).select("bucket", "row", "b", "facts", F.inline_outer("pieces"))
    slim = cuts.select("bucket", "row", F.when(F.col("kind") == 2, F.col("facts")).alias("facts"), "b", "kind", "early", "base", "part")
    entries = _chosen(slim, ["bucket", "row", "facts", "b"], k, w)
    old = (F.col("kind") == 0) & (F.col("window") + F.lit(w + k - 1) <= F.col("b"))
    gathered = entries.groupBy("bucket", "row").agg(
        F.max("facts").alias("facts"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == 0, F.col("code")))).alias("codes"),
        F.sort_array(F.array_distinct(F.collect_list(F.when((F.col("kind") == 1) | old, F.col("code"))))).alias("edited_codes"),
    )
    following = Window.partitionBy("bucket").orderBy("row")
    sets = gathered.select("*", hashes_of(F.col("codes")).alias("h")).select("*", F.lead("h").over(following).alias("hn")).where("NOT facts.ghost")
    done = sets.select("facts.*", "codes", "edited_codes", "h", "hn", hashes_of(F.col("edited_codes")).alias("he"))
    return done.select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        text_of(F.col("codes")).alias("fingerprint"),
        text_of(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("he")).alias("near_edited"),
        likeness(F.col("h"), F.col("hn")).alias("near_next"),
    )
