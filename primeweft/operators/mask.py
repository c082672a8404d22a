"""Variable positions: pileup over haplotypes, masked islands, the widest zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the most intervals that primer design takes.
MAX_REGIONS = 200


def cs_tokens(cs: Column) -> Column:
    """Tokens of a difference string as an array of (op, text)."""
    found = F.regexp_extract_all(cs, F.lit(r"(:\d+|\*[a-z][a-z]|[+\-][a-z]+|=[A-Za-z]+)"), F.lit(1))
    return F.transform(found, lambda t: F.struct(F.substring(t, 1, 1).alias("op"), F.substring(t, F.lit(2), F.length(t)).alias("text")))


def variants(alignments: DataFrame, length: Column) -> DataFrame:
    """(template, pos) of each variant of alignments (template, r_start, cs).

    A substitution marks its position, a deletion each missing one, an insertion the
    position before which it stands.  Marks are a bag: an insertion and a substitution
    at one position count two.  Each string is walked by a fold in its own row.  Marks come
    dealt by template.
    """
    none = F.array().cast("array<bigint>")

    def step(a: Column, t: Column) -> Column:
        op, n = t["op"], F.length(t["text"]).cast("long")
        span = F.when(op == ":", t["text"].try_cast("long")).when(op == "*", 1).when(op == "+", 0).otherwise(n)
        marks = F.when(op.isin("*", "+"), F.array(a["at"])).when(op == "-", F.sequence(a["at"], a["at"] + n - 1)).otherwise(none)
        return F.struct((a["at"] + span).alias("at"), F.concat(a["marks"], marks).alias("marks"))

    start = F.struct(F.col("r_start").cast("long").alias("at"), none.alias("marks"))
    marks = F.filter(F.aggregate(cs_tokens(F.col("cs")), start, step)["marks"], lambda p: (p >= 0) & (p < F.col("_n")))
    # what a task counts at first grows with the templates it meets: they are dealt out, in rows of their own, and a large one over several tasks
    dealt = alignments.select("template", "r_start", "cs", length.alias("_n")).select("template", F.hash("template").alias("_part"), marks.alias("marks")).hint("rebalance", "_part")
    # outer, as Spark would else walk each string once more to leave out those without marks
    return dealt.select("template", F.explode_outer("marks").alias("pos")).where("pos is not null")


def pileup(marks: DataFrame) -> DataFrame:
    return marks.groupBy("template", "pos").agg(F.count(F.lit(1)).alias("n_variants"))


def islands(positions: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """(keys, start, length) of distinct positions (pos), joined where at most ``gap`` lie between.

    Gaps and islands: a position starts one if it is over the last plus 1 plus gap.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    begins = (F.col("pos") - F.lag("pos").over(w) > gap + 1).cast("int")
    numbered = positions.select(*keys, "pos").distinct().withColumn("n", F.coalesce(begins, F.lit(0))).withColumn("island", F.sum("n").over(w))
    return numbered.groupBy(*keys, "island").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("length")).drop("island")


def widest(regions: DataFrame, keys: list[str], most: int = MAX_REGIONS) -> DataFrame:
    """The ``most`` longest regions of each key, the earlier first among equal ones."""
    w = Window.partitionBy(*keys).orderBy(F.col("length").desc(), "start")
    return regions.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i")


def excluded_regions(counts: DataFrame, aligned: DataFrame, min_freq: float = 0.05, gap: int = 25, most: int = MAX_REGIONS) -> DataFrame:
    """(template, start, length) to keep primers off. ``aligned``: template, n (aligned haplotypes)."""
    masked = counts.join(aligned, "template").where(F.col("n_variants") / F.col("n") >= min_freq)
    return widest(islands(masked, ["template"], gap), ["template"], most)
