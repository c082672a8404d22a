"""Primer picking: windows of allowed length, temperature and make-up, paired by product size.

Dimers and hairpins are judged by runs of paired bases, not by an alignment's energy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import overlaps, revcomp
from ..functions.thermo import oligo_tm


@dataclass(frozen=True)
class Design:
    product_min: int = 100
    product_max: int = 300
    length_min: int = 18
    length_opt: int = 20
    length_max: int = 27
    tm_min: float = 57.0
    tm_opt: float = 60.0
    tm_max: float = 63.0
    n_candidates: int = 20
    #: Share of G and C in percent, and bases of one kind in a row at most.
    gc_min: float = 20.0
    gc_max: float = 80.0
    max_poly: int = 5
    #: Paired bases in a row that are too many: of a primer with itself or its partner, of a 3' end
    #: with either, and of a hairpin's stem, whose loop has ``loop`` bases at least.
    max_dimer: int = 8
    max_end: int = 6
    max_stem: int = 6
    loop: int = 3


def pairs_with(a: Column, b: Column, run: int) -> Column:
    """Whether ``run`` bases in a row of a pair with such of b."""
    other = revcomp(b)
    return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - run + 1)), lambda i: (F.length(a) >= run) & other.contains(F.substring(a, i, F.lit(run))))


def end_pairs_with(a: Column, b: Column, run: int) -> Column:
    """Whether the last ``run`` bases of a pair with such of b."""
    return revcomp(b).contains(F.substring(a, -run, run))


def has_hairpin(s: Column, stem: int, loop: int) -> Column:
    """Whether ``stem`` bases in a row pair with such at least ``loop`` bases further on."""
    last = F.length(s) - 2 * stem - loop + 1
    folds = lambda i: F.instr(F.substring(s, i + stem + loop, F.length(s)), revcomp(F.substring(s, i, F.lit(stem)))) > 0
    return (last >= 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), folds)


def is_usable(s: Column, d: Design) -> Column:
    """GC share, runs of one base, self-dimers and hairpins of an upper-cased oligo."""
    gc = F.length(F.regexp_replace(s, "[^GC]", "")) * 100.0 / F.length(s)
    return gc.between(d.gc_min, d.gc_max) & ~s.rlike(rf"(.)\1{{{d.max_poly}}}") & ~pairs_with(s, s, d.max_dimer) & ~end_pairs_with(s, s, d.max_end) & ~has_hairpin(s, d.max_stem, d.loop)


def oligos(templates: DataFrame, excluded: DataFrame, d: Design) -> DataFrame:
    """(template, side, start, length, sequence, penalty) of usable windows off the excluded regions."""
    n = F.length("sequence")
    starts = F.explode(F.when(n >= d.length_min, F.sequence(F.lit(0), n - d.length_min)).otherwise(F.array().cast("array<int>")))
    windows = templates.withColumn("start", starts).withColumn("length", F.explode(F.sequence(F.lit(d.length_min), F.lit(d.length_max)))).where(F.col("start") + F.col("length") <= n)
    cut = windows.withColumn("plus", F.upper(F.substring(F.col("sequence"), F.col("start") + 1, F.col("length")))).where("not plus rlike '[^ACGT]'")
    # a mask is widened to buckets of the longest primer, which makes the range test an equi-join
    zones = excluded.select("template", F.col("start").alias("x_start"), (F.col("start") + F.col("length")).alias("x_end"))
    bucket = F.lit(d.length_max)
    zones = zones.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("x_start") / bucket) - 1, F.floor(F.col("x_end") / bucket))))
    hit = (cut["template"] == zones["template"]) & (F.floor(cut["start"] / bucket) == zones["bucket"]) & overlaps(cut["start"], cut["start"] + cut["length"], zones["x_start"], zones["x_end"])
    free = cut.join(zones, hit, "left_anti")
    scored = free.withColumn("tm", oligo_tm(F.col("plus"))).where(F.col("tm").between(d.tm_min, d.tm_max)).withColumn("minus", revcomp(F.col("plus")))
    # rounded, so that equal penalties stay equal in sums
    penalty = F.round(F.abs(F.col("tm") - d.tm_opt) + F.abs(F.col("length") - d.length_opt), 6)
    # an end and its hairpins are those of the strand that the primer is on
    runs = F.transform(F.sequence(F.lit(1), F.length("plus") - d.max_dimer + 1), lambda i: F.substring(F.col("plus"), i, F.lit(d.max_dimer)))
    return scored.withColumn("runs", runs).select("template", "start", "length", "plus", "minus", "runs", penalty.alias("penalty"), is_usable(F.col("plus"), d).alias("left_ok"), is_usable(F.col("minus"), d).alias("right_ok")).where("left_ok or right_ok")


def candidates(templates: DataFrame, excluded: DataFrame, d: Design = Design()) -> DataFrame:  # noqa: B008
    """The n pairs of least penalty of each template (template, sequence), least penalty first.

    Pair names are ``template_pair0``, ``template_pair1``, ...
    """
    o = oligos(templates, excluded, d)
    size = F.lit(d.product_max)
    left = o.where("left_ok").select("template", F.col("start").alias("left_start"), F.col("length").alias("left_length"), F.col("plus").alias("forward"), F.col("penalty").alias("p_left"), F.col("runs").alias("left_runs"))
    left = left.withColumn("bucket", F.explode(F.array(F.floor(F.col("left_start") / size), F.floor(F.col("left_start") / size) + 1)))
    right = o.where("right_ok").select("template", F.col("start").alias("right_start"), F.col("length").alias("right_length"), F.col("minus").alias("reverse"), F.col("plus").alias("other"), F.col("penalty").alias("p_right"), F.col("runs").alias("right_runs"))
    right = right.withColumn("right_end", F.col("right_start") + F.col("right_length")).withColumn("bucket", F.floor(F.col("right_end") / size))
    # a stated number of partitions: few templates make very many pairs
    n = int(templates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(n, "template", "bucket").join(right.repartition(n, "template", "bucket"), ["template", "bucket"]).withColumn("product", F.col("right_end") - F.col("left_start"))
    ok = pairs.where(F.col("product").between(d.product_min, d.product_max) & (F.col("left_start") + F.col("left_length") <= F.col("right_start")))
    # a reverse primer pairs with what its place on the plus strand has
    f, other = F.col("forward"), F.col("other")
    ends = other.contains(F.substring(f, -d.max_end, d.max_end)) | f.contains(F.substring(other, 1, d.max_end))
    apart = ~ends & ~F.arrays_overlap("left_runs", "right_runs")
    scored = ok.withColumn("penalty", F.round(F.col("p_left") + F.col("p_right"), 6)).where(apart)
    order = Window.partitionBy("template").orderBy("penalty", "left_start", "left_length", "right_start", "right_length")
    top = scored.withColumn("candidate_idx", F.row_number().over(order) - 1).where(F.col("candidate_idx") < d.n_candidates)
    return top.withColumn("pair", F.concat("template", F.lit("_pair"), F.col("candidate_idx"))).select("template", "pair", "candidate_idx", "forward", "reverse", "left_start", "left_length", "right_start", "right_length", "product", "penalty")
