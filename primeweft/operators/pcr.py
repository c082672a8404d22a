"""From sites to competent sites, amplicons, statuses, metrics and ranks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import contained, revcomp
from ..functions.thermo import Conditions, duplex_tm, pair_tm
from ..scratch import written

STATUSES = ("pass", "dropout", "off_target", "multi_product", "uncertain")


@dataclass(frozen=True)
class Rule:
    max_total: int = 2
    max_3prime: int = 0
    suffix: int = 5


@dataclass(frozen=True)
class Thermo:
    #: Temperature that sites are held against; None: the lower one of each pair's primers.
    design_tm: float | None = None
    drop: float = 5.0
    hard: int = 2
    conditions: Conditions = field(default_factory=lambda: Conditions(oligo=250.0))


@dataclass(frozen=True)
class Evaluation:
    mode: str = "thermo"
    max_mismatches: int = 3
    min_product: int = 100
    max_product: int = 300
    #: Competent sites of a primer beyond which its cell isn't enumerated; 0 or None: never.
    max_sites: int | None = 100
    rule: Rule = Rule()
    thermo: Thermo = field(default_factory=Thermo)


@dataclass(frozen=True)
class Ranking:
    min_coverage: float = 0.95
    max_off_target: int = 0
    max_multi_product: int = 0
    min_evaluable: int = 1


def near_3prime(offsets: Column, n: int) -> Column:
    """Mismatches within n bases of the 3' end."""
    return F.size(F.filter(offsets, lambda o: o < n))


def rule_reason(sites: DataFrame, rule: Rule) -> DataFrame:
    """``sites`` with competent and reason, by counts of mismatches."""
    m, tail = F.col("mismatches"), near_3prime(F.col("offsets_3p"), rule.suffix)
    reason = (
        F.when(m > rule.max_total, F.format_string(f"%d mismatches > max {rule.max_total}", m))
        .when(tail > rule.max_3prime, F.format_string(f"%d mismatch(es) within 3' {rule.suffix}nt > max {rule.max_3prime}", tail))
        .otherwise("ok")
    )
    return sites.withColumn("reason", reason).withColumn("competent", F.col("reason") == "ok")


def thermo_reason(sites: DataFrame, thermo: Thermo) -> DataFrame:
    """``sites`` with query, window (top strand) and design_tm judged by the 3' gate, then by temperatures.

    Temperatures are expressions in the JVM.
    """
    least = F.col("design_tm") - thermo.drop
    aligned = F.when(F.col("strand") == "+", F.upper("window")).otherwise(revcomp(F.upper("window")))
    gated = sites.withColumn("_gate", near_3prime(F.col("offsets_3p"), thermo.hard) > 0).withColumn("_aligned", aligned)
    stopped = gated.where("_gate").withColumn("reason", F.lit(f"mismatch within 3' terminal {thermo.hard}nt"))
    scored = gated.where("not _gate").withColumn("_tm", duplex_tm(F.upper("query"), F.col("_aligned"), thermo.conditions)).withColumn("_end", duplex_tm(F.upper("query"), F.col("_aligned"), thermo.conditions, end=True))
    # rounding makes no negative zero, which the texts have
    one = lambda c: F.concat(F.when((c < 0) & (F.bround(c, 1) == 0), "-").otherwise(""), F.format_string("%.1f", F.bround(c, 1)))
    fits = (F.col("_tm") >= least) & (F.col("_end") >= least - 10.0)
    why = (
        F.when(F.col("_tm") < least, F.concat(F.lit("annealing Tm "), one(F.col("_tm")), F.lit("C < "), one(least), F.lit("C")))
        .when(F.col("_end") < least - 10.0, F.concat(F.lit("3' end unstable (Tm "), one(F.col("_end")), F.lit("C)")))
        .otherwise(F.concat(F.lit("annealing Tm "), one(F.col("_tm")), F.lit("C")))
    )
    both = scored.withColumn("reason", why).withColumn("competent", fits).drop("_tm", "_end").unionByName(stopped.withColumn("competent", F.lit(False)))
    return both.drop("_gate", "_aligned")


def capped(sites: DataFrame, keys: list[str], cap: int | None) -> DataFrame:
    """For each key the number of competent sites and whether it is over the cap."""
    counts = sites.groupBy(*keys).agg(F.count_if("competent").alias("n_competent"))
    return counts.withColumn("capped", F.col("n_competent") > cap if cap else F.lit(False))


def amplicons(sites: DataFrame, keys: list[str], least: int, most: int | str) -> DataFrame:
    """Every plus site before a minus site at a product size within bounds, as a bag.

    ``sites``: keys (with the contig), strand, start, end.  The range join becomes an
    equi-join on buckets of the largest product: a minus site ends in the plus
    site's bucket or the next one.  ``most`` may name a column of bounds, one for each
    value of the keys, which then are the widths of its buckets.
    """
    own = [most] if isinstance(most, str) else []
    plus = sites.where("strand = '+'").select(*keys, *own, F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("role").alias("p_role"))
    minus = sites.where("strand = '-'").select(*keys, *own, F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("role").alias("m_role"))
    size = F.greatest(F.lit(1).cast("long"), F.col(most)) if own else F.lit(max(1, most))
    plus = plus.withColumn("bucket", F.explode(F.array(F.floor(F.col("p_start") / size), F.floor(F.col("p_start") / size) + 1)))
    minus = minus.withColumn("bucket", F.floor(F.col("m_end") / size))
    both = plus.join(minus.drop(*own), [*keys, "bucket"])
    product = F.col("m_end") - F.col("p_start")
    kept = both.where((F.col("p_start") <= F.col("m_start")) & product.between(least, F.col(most) if own else most))
    return kept.select(*keys, F.col("p_start").alias("start"), F.col("m_end").alias("end"), product.alias("size"), "p_role", "m_role")


def statuses(grid: DataFrame, products: DataFrame, keys: list[str]) -> DataFrame:
    """``grid`` (keys, projected, capped, which, cap, dropout_reason) with status, reason and the sizes.

    ``products``: keys, size, on_target; with places, they are listed in ``products``.
    """
    listed = [c for c in ("chrom", "start", "end") if c in products.columns]
    each = F.array_sort(F.collect_list(F.struct(*listed, "size", "on_target"))).alias("products")
    per = products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_products"),
        F.count_if("on_target").alias("n_on"),
        F.array_sort(F.collect_list(F.when(F.col("on_target"), F.col("size")))).alias("on_sizes"),
        F.array_sort(F.collect_list(F.when(~F.col("on_target"), F.col("size")))).alias("off_sizes"),
        *([each] if len(listed) == 3 else []),
    )
    none = F.array().cast("array<bigint>")
    open_ = F.col("projected") & ~F.col("capped")
    n, on = (F.when(open_, F.coalesce(c, F.lit(0).cast("long"))).otherwise(0) for c in ("n_products", "n_on"))
    joined = grid.join(per, keys, "left").withColumn("n_products", n).withColumn("n_on", on)
    for c in ("on_sizes", "off_sizes"):
        joined = joined.withColumn(c, F.when(open_, F.coalesce(c, none)).otherwise(none))
    if len(listed) == 3:
        no = F.array().cast(per.schema["products"].dataType)
        joined = joined.withColumn("products", F.when(open_, F.coalesce("products", no)).otherwise(no))
    status = (
        F.when(~F.col("projected"), "uncertain")
        .when(F.col("capped"), "multi_product")
        .when(F.col("n_products") == 0, "dropout")
        .when(F.col("n_products") > 1, "multi_product")
        .when(F.col("n_on") == 1, "pass")
        .otherwise("off_target")
    )
    reason = (
        F.when(~F.col("projected"), "locus not reliably projected onto this haplotype")
        .when(F.col("capped"), F.concat(F.lit(">"), F.col("cap"), F.lit(" binding sites ("), F.col("which"), F.lit(" primer); likely repeat-derived")))
        .when(F.col("n_products") == 0, F.coalesce("dropout_reason", F.lit("no amplification-competent product")))
        .when(F.col("n_products") > 1, F.format_string("%d products (%d on-target)", "n_products", "n_on"))
        .when(F.col("n_on") == 1, F.format_string("single on-target product %d bp", F.try_element_at("on_sizes", F.lit(1))))
        .otherwise(F.format_string("single off-target product %d bp", F.try_element_at("off_sizes", F.lit(1))))
    )
    return joined.withColumn("status", status).withColumn("reason", reason).drop("dropout_reason", "which")


def first_reasons(sites: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """For each key the first n rejections: forward before reverse, in the order of contigs, strands and starts."""
    order = Window.partitionBy(*keys).orderBy(F.col("role"), F.col("contig_idx"), F.col("strand"), F.col("start"))
    text = F.format_string("%s@%s:%d %s", F.col("primer_name"), F.col("chrom").cast("string"), F.col("start"), F.col("reason"))
    top = sites.where("not competent").withColumn("i", F.row_number().over(order)).where(F.col("i") <= n).withColumn("t", text)
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("r")).select(*keys, F.array_join("r.t", "; ").alias("dropout_reason"))


def cell_summary(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of the cells of each key in one aggregation.

    ``cells``: status, n_on, capped.
    """
    evaluable = F.col("status") != "uncertain"
    covered = evaluable & (F.col("n_on") > 0)
    out = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(evaluable).alias("evaluable"),
        F.count_if(covered).alias("n_covered"),
        *[F.count_if(F.col("status") == s).alias("n_" + s) for s in STATUSES],
        F.count_if("capped").alias("n_capped"),
    )
    share = lambda c: F.coalesce(F.col(c) / F.when(F.col("evaluable") > 0, F.col("evaluable")), F.lit(0.0))
    return out.withColumn("coverage", share("n_covered")).withColumn("unique_rate", share("n_pass"))


def console_dropouts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The console's counts: every projected cell without an on-target product is a dropout there."""
    return cells.groupBy(*keys).agg(F.count_if((F.col("status") != "uncertain") & (F.col("n_on") == 0)).alias("dropouts"), F.count_if(F.size("off_sizes") > 0).alias("with_off_target"), F.count(F.lit(1)).alias("cells"))


def reject_reasons(metrics: DataFrame, r: Ranking) -> DataFrame:
    """``metrics`` with reject_reasons (an array in fixed order) and passed."""
    from ..functions.sequences import percent

    least = f"{r.min_coverage * 100:.2f}%"
    reasons = F.array_compact(
        F.array(
            F.when(F.col("evaluable") < r.min_evaluable, F.format_string(f"only %d evaluable haplotypes (< {r.min_evaluable}); %d uncertain", "evaluable", "n_uncertain")),
            F.when(F.col("coverage") < r.min_coverage, F.concat(F.lit("coverage "), percent(F.col("coverage")), F.lit(f" < {least} ("), F.col("n_dropout"), F.lit(" dropout)"))),
            F.when(F.col("n_off_target") > r.max_off_target, F.format_string(f"%d off-target haplotypes > {r.max_off_target}", "n_off_target")),
            F.when(F.col("n_multi_product") > r.max_multi_product, F.format_string(f"%d multi-product haplotypes > {r.max_multi_product}", "n_multi_product")),
        )
    )
    return metrics.withColumn("reject_reasons", reasons).withColumn("passed", F.size("reject_reasons") == 0)


RANK_ORDER = [("passed", True), ("coverage", True), ("unique_rate", True), ("n_off_target", False), ("n_multi_product", False), ("penalty", False), ("pair", False)]


def rank(metrics: DataFrame, r: Ranking = Ranking()) -> DataFrame:  # noqa: B008
    """Pairs with their rank: those that pass first, then by coverage, uniqueness, bands, penalty and name.

    The table has a row for each primer pair; its order is a global sort.
    """
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in RANK_ORDER]
    return reject_reasons(metrics, r).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def shortlist(metrics: DataFrame, k: int | None) -> DataFrame:
    """The k pairs of largest coverage, then least penalty, then first; all if k is 0 or none."""
    ordered = metrics.orderBy(F.col("coverage").desc(), "penalty", "candidate_idx")
    return ordered.limit(k) if k else ordered


def primers_of(pairs: DataFrame, design_tm: float | None = None) -> DataFrame:
    """(pair, role, query, design_tm): both primers of each pair, upper-cased."""
    tm = F.lit(design_tm) if design_tm is not None else pair_tm(F.upper("forward"), F.upper("reverse"))
    both = F.explode(F.array(F.struct(F.lit("F").alias("role"), F.upper("forward").alias("query")), F.struct(F.lit("R").alias("role"), F.upper("reverse").alias("query"))))
    return pairs.select("pair", tm.cast("double").alias("design_tm"), both.alias("p")).select("pair", "p.role", "p.query", "design_tm")


def judged(pairs: DataFrame, contigs: DataFrame, config: Evaluation, how: str | None = None) -> DataFrame:
    """All sites of both primers of each pair, competent or not and why.

    A primer of several pairs is sought once; its sites are judged by each pair's own
    temperature.  The table is written to the scratch space: counts, products and
    reasons all read it, and sites are few beside the bases searched.
    """
    from .search import search

    if config.mode not in ("rule", "thermo"):
        raise ValueError(f"unknown mode {config.mode!r}")
    primers = primers_of(pairs, config.thermo.design_tm)
    sites = search(contigs, primers.select("query"), config.max_mismatches, how, window=config.mode == "thermo").withColumn("end", F.col("start") + F.length("query"))
    sites = sites.join(primers, "query")
    ruled = rule_reason(sites, config.rule) if config.mode == "rule" else thermo_reason(sites, config.thermo).drop("window")
    return written(ruled.drop("design_tm").withColumn("primer_name", F.col("query")), "sites")[0]


def gridded(sites: DataFrame, grid: DataFrame, max_sites: int | None) -> DataFrame:
    """``grid`` (pair, haplotype, projected) with which primers are over the cap, capped, and the cap."""
    keys = ["pair", "haplotype"]
    over = capped(sites, [*keys, "role"], max_sites).where("capped")
    names = F.array_sort(F.collect_set(F.when(F.col("role") == "F", "forward").otherwise("reverse")))
    which = over.groupBy(*keys).agg(F.array_join(names, " and ").alias("which"))
    return grid.join(which, keys, "left").withColumn("capped", F.col("which").isNotNull() & F.col("projected")).withColumn("cap", F.lit(max_sites).cast("string"))


def products_of(sites: DataFrame, grid: DataFrame, config: Evaluation, bounds: DataFrame | None = None) -> DataFrame:
    """Products of competent sites in the cells of a grid (see `gridded`) that are enumerated.

    ``bounds`` (pair, max_product) may have a largest product for each pair.
    """
    good = sites.where("competent").join(grid.where("projected and not capped").select("pair", "haplotype"), ["pair", "haplotype"])
    keys = ["pair", "haplotype", "chrom", "contig_idx"]
    if bounds is not None:
        return amplicons(good.join(bounds.select("pair", F.col("max_product").cast("long").alias("max_product")), "pair"), keys, config.min_product, "max_product")
    return amplicons(good, keys, config.min_product, config.max_product)


def decided(sites: DataFrame, grid: DataFrame, products: DataFrame) -> DataFrame:
    """The cells of a grid with status, reason, sizes and flags; ``products`` with on_target."""
    keys = ["pair", "haplotype"]
    seen = sites.groupBy(*keys).agg((F.count_if(F.col("role") == "F") > 0).alias("f"), (F.count_if(F.col("role") == "R") > 0).alias("r"))
    missing = F.when(~F.coalesce("f", F.lit(False)) | ~F.coalesce("r", F.lit(False)), "a primer has no binding site in the expected locus").otherwise("no convergent product within the product-size window")
    grid = grid.join(seen, keys, "left").join(first_reasons(sites, keys), keys, "left").withColumn("dropout_reason", F.coalesce("dropout_reason", missing)).drop("f", "r")
    return statuses(grid, products, keys)


def evaluate(pairs: DataFrame, contigs: DataFrame, loci: DataFrame, config: Evaluation = Evaluation(), how: str | None = None) -> DataFrame:  # noqa: B008
    """A row for each pair and haplotype with status, reason, sizes and flags.

    ``pairs``: pair, forward, reverse, and max_product where pairs have bounds of their
    own; ``contigs``: haplotype, chrom, contig_idx, sequence
    (and base, own where a reader has cut them); ``loci``: pair, haplotype, chrom, start,
    end (null chrom: not projected), at most one row for each pair and haplotype, and
    one for each that is to be judged.
    """
    sites = judged(pairs, contigs, config, how)
    grid = gridded(sites, loci.select("pair", "haplotype", F.col("chrom").isNotNull().alias("projected")), config.max_sites)
    expected = loci.select("pair", "haplotype", F.col("chrom").alias("l_chrom"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    made = products_of(sites, grid, config, pairs if "max_product" in pairs.columns else None).join(expected, ["pair", "haplotype"])
    on = (F.col("chrom") == F.col("l_chrom")) & contained(F.col("start"), F.col("end"), F.col("l_start"), F.col("l_end"))
    return decided(sites, grid, made.withColumn("on_target", on))
