"""The library's inputs on the driver's tables.

A document is a contig of haplotype ``doc_id % 8``; passages of ``benchmark`` give
primer pairs, the forward at bases 11 to 30, the reverse the reverse complement of
bases 61 to 80.  Haplotype 7 counts as not projected, the first half of a contig
as the expected locus.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import encode_text, revcomp
from ..functions.thermo import NO_DUPLEX, oligo_tm, pair_tm, stacks
from ..operators import pcr, search

RULE = pcr.Rule(max_total=2, max_3prime=0, suffix=5)
LEAST, MOST, CAP, K = 40, 300, 12, 3
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
TURNED = ("ACGT" * 7)[:26] * 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The small input files dealt over the cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * n) if df.rdd.getNumPartitions() < n else df


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select((F.col("doc_id") % 8).alias("haplotype"), F.col("doc_id").alias("contig"), encode_text(F.coalesce("text", F.lit(""))).alias("sequence"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = read(spark, sf_dir, "benchmark").select("item_id", encode_text(F.col("text")).alias("s")).where(F.length("s") >= 80)
    return enc.select(F.concat(F.lit("p"), "item_id").alias("pair"), F.col("item_id").alias("candidate_idx"), F.substring("s", 11, 20).alias("forward"), revcomp(F.substring("s", 61, 20)).alias("reverse"))


def sites(spark: SparkSession, sf_dir: str, how: str = "arrow", window: bool = False) -> DataFrame:
    p = pcr.primers_of(pairs(spark, sf_dir))
    return search.search(contigs(spark, sf_dir), p.select("query"), K, how, window=window).withColumn("end", F.col("start") + F.length("query"))


EVALUATION = pcr.Evaluation("rule", K, LEAST, MOST, CAP, RULE)


def judged(spark: SparkSession, sf_dir: str, config: pcr.Evaluation = EVALUATION) -> DataFrame:
    """Competent or not, for each pair and role that has the primer; a document is a contig by its own name."""
    named = contigs(spark, sf_dir).select("haplotype", F.col("contig").alias("chrom"), F.col("contig").alias("contig_idx"), "sequence")
    return pcr.judged(pairs(spark, sf_dir), named, config)


def gridded(spark: SparkSession, sf_dir: str, all_sites: DataFrame) -> DataFrame:
    """Every pair is judged on every haplotype: both tables are small by nature."""
    haplotypes = read(spark, sf_dir, "documents").select((F.col("doc_id") % 8).alias("haplotype")).distinct()
    grid = pairs(spark, sf_dir).select("pair").join(haplotypes, how="cross").withColumn("projected", F.col("haplotype") != 7)
    return pcr.gridded(all_sites, grid, CAP)


def products(spark: SparkSession, sf_dir: str, all_sites: DataFrame, grid: DataFrame) -> DataFrame:
    """Products, on target in the first half of their contig."""
    half = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chrom"), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).alias("half"))
    return pcr.products_of(all_sites, grid, EVALUATION).join(half, "chrom").withColumn("on_target", F.col("end") <= F.col("half"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair and haplotype."""
    all_sites = judged(spark, sf_dir)
    grid = gridded(spark, sf_dir, all_sites)
    return pcr.decided(all_sites, grid, products(spark, sf_dir, all_sites, grid))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pcr.cell_summary(cells(spark, sf_dir), ["pair"])
    p = pairs(spark, sf_dir)
    penalty = F.round(F.abs(oligo_tm(F.col("forward")) - 60) + F.abs(oligo_tm(F.col("reverse")) - 60), 6)
    return out.join(p.select("pair", "candidate_idx", penalty.alias("penalty"), F.round(pair_tm(F.col("forward"), F.col("reverse")), 6).alias("pair_tm")), "pair")


# ---------------------------------------------------------------- the same in SQL
def sql_encode(x: str) -> str:
    return f"regexp_replace(translate({x}, '{LETTERS}', '{TURNED}'), '[^ACGT]', 'N', 'g')"


def sql_revcomp(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTNacgtn', 'TGCANtgcan'))"


SQL_PAIRS = f"""
enc AS (SELECT item_id, {sql_encode("text")} AS s FROM benchmark),
pr AS (SELECT 'p' || item_id AS pair, item_id AS candidate_idx, substr(s, 11, 20) AS forward, {sql_revcomp("substr(s, 61, 20)")} AS reverse FROM enc WHERE length(s) >= 80),
roles AS (SELECT pair, 'F' AS role, forward AS query FROM pr UNION ALL SELECT pair, 'R', reverse FROM pr)"""

#: A hit of at most 3 mismatches has one of four segments right, which makes the search an equi-join.
SQL_SITES = f"""
{SQL_PAIRS},
q AS (SELECT DISTINCT query FROM roles),
o AS (SELECT query, '+' AS strand, query AS pattern FROM q UNION ALL SELECT query, '-', {sql_revcomp("query")} FROM q),
ctg AS (SELECT doc_id % 8 AS haplotype, doc_id AS contig, {sql_encode("coalesce(text, '')")} AS seq FROM documents),
win AS MATERIALIZED (SELECT haplotype, contig, i, substr(seq, i + 1, 20) AS w FROM (SELECT haplotype, contig, seq, unnest(range(0, length(seq) - 19)) AS i FROM ctg)),
near AS (
{" UNION ".join(f"SELECT haplotype, contig, i, w, query, strand, pattern FROM win JOIN o ON substr(w, {a}, 5) = substr(pattern, {a}, 5) WHERE hamming(w, pattern) <= 3" for a in (1, 6, 11, 16))}),
sites AS (SELECT haplotype, contig, query, strand, i AS start, i + 20 AS "end", hamming(w, pattern) AS mismatches,
  list_sort(list_transform(list_filter(range(0, 20), lambda x: w[x + 1] <> pattern[x + 1]), lambda x: CASE WHEN strand = '+' THEN 19 - x ELSE x END)) AS offsets_3p FROM near),
ruled AS (SELECT *, len(list_filter(offsets_3p, lambda x: x < 5)) AS tail FROM sites),
judged AS (SELECT r.*, pair, role, CASE WHEN mismatches > 2 THEN mismatches || ' mismatches > max 2' WHEN tail > 0 THEN tail || ' mismatch(es) within 3'' 5nt > max 0' ELSE 'ok' END AS reason FROM ruled r JOIN roles USING (query))"""

SQL_CELLS = f"""
{SQL_SITES},
cnt AS (SELECT pair, haplotype, role, count(*) FILTER (reason = 'ok') AS n_competent FROM judged GROUP BY ALL),
which AS (SELECT pair, haplotype, string_agg(CASE WHEN role = 'F' THEN 'forward' ELSE 'reverse' END, ' and ' ORDER BY role) AS which FROM cnt WHERE n_competent > {CAP} GROUP BY ALL),
grid AS (SELECT pair, haplotype, haplotype <> 7 AS projected, which, which IS NOT NULL AND haplotype <> 7 AS capped FROM (SELECT pair FROM pr) CROSS JOIN (SELECT DISTINCT doc_id % 8 AS haplotype FROM documents) LEFT JOIN which USING (pair, haplotype)),
good AS (SELECT j.* FROM judged j JOIN grid g USING (pair, haplotype) WHERE reason = 'ok' AND projected AND NOT capped),
amp AS (SELECT a.pair, a.haplotype, a.contig, a.start, b."end", b."end" - a.start AS size, a.role AS p_role, b.role AS m_role, b."end" <= floor(length(coalesce(d.text, '')) / 2) AS on_target
  FROM good a JOIN good b ON a.pair = b.pair AND a.haplotype = b.haplotype AND a.contig = b.contig AND a.strand = '+' AND b.strand = '-' AND a.start <= b.start AND b."end" - a.start BETWEEN {LEAST} AND {MOST}
  JOIN documents d ON d.doc_id = a.contig),
per AS (SELECT pair, haplotype, count(*) AS n, count(*) FILTER (on_target) AS n_on, list(size ORDER BY size) FILTER (on_target) AS on_sizes, list(size ORDER BY size) FILTER (NOT on_target) AS off_sizes FROM amp GROUP BY ALL),
bad AS (SELECT pair, haplotype, string_agg(t, '; ' ORDER BY i) AS why FROM (SELECT pair, haplotype, query || '@' || contig || ':' || start || ' ' || reason AS t, row_number() OVER (PARTITION BY pair, haplotype ORDER BY role, contig, strand, start) AS i FROM judged WHERE reason <> 'ok') WHERE i <= 3 GROUP BY ALL),
seen AS (SELECT pair, haplotype, count(*) FILTER (role = 'F') > 0 AND count(*) FILTER (role = 'R') > 0 AS both_seen FROM judged GROUP BY ALL),
cells AS (SELECT pair, haplotype, projected, capped, coalesce(n, 0) AS n_products, coalesce(n_on, 0) AS n_on, coalesce(on_sizes, []) AS on_sizes, coalesce(off_sizes, []) AS off_sizes,
  CASE WHEN NOT projected THEN 'uncertain' WHEN capped THEN 'multi_product' WHEN coalesce(n, 0) = 0 THEN 'dropout' WHEN n > 1 THEN 'multi_product' WHEN n_on = 1 THEN 'pass' ELSE 'off_target' END AS status,
  CASE WHEN NOT projected THEN 'locus not reliably projected onto this haplotype'
    WHEN capped THEN '>{CAP} binding sites (' || which || ' primer); likely repeat-derived'
    WHEN coalesce(n, 0) = 0 THEN coalesce(why, CASE WHEN NOT coalesce(both_seen, FALSE) THEN 'a primer has no binding site in the expected locus' ELSE 'no convergent product within the product-size window' END)
    WHEN n > 1 THEN n || ' products (' || n_on || ' on-target)' WHEN n_on = 1 THEN 'single on-target product ' || on_sizes[1] || ' bp' ELSE 'single off-target product ' || off_sizes[1] || ' bp' END AS reason
  FROM grid LEFT JOIN per USING (pair, haplotype) LEFT JOIN bad USING (pair, haplotype) LEFT JOIN seen USING (pair, haplotype))"""

_H = {79: "AA TT", 72: "AT TA", 85: "CA TG", 84: "GT AC", 78: "CT AG", 82: "GA TC", 106: "CG", 98: "GC", 80: "GG CC"}
_S = {222: "AA TT GA TC", 204: "AT", 213: "TA", 227: "CA TG", 224: "GT AC", 210: "CT AG", 272: "CG", 244: "GC", 199: "GG CC"}


def _sql_sum(x: str, table: dict[int, str]) -> str:
    cases = " ".join(f"WHEN substr({x}, i, 2) IN ({', '.join(repr(s) for s in stacks.split())}) THEN {v}" for v, stacks in table.items())
    return f"list_sum(list_transform(range(1, length({x})), lambda i: CASE {cases} ELSE 0 END))"


def _sql_end(x: str, weak: int, strong: int) -> str:
    return " + ".join(f"(CASE WHEN {c} IN ('A', 'T') THEN {weak} WHEN {c} IN ('C', 'G') THEN {strong} ELSE 0 END)" for c in (f"{x}[1]", f"{x}[-1]"))


def sql_tm(x: str) -> str:
    same = f"{x} = reverse(translate({x}, 'ACGT', 'TGCA'))"
    h = f"({_sql_sum(x, _H)} + {_sql_end(x, -23, -1)})"
    s = f"({_sql_sum(x, _S)} + {_sql_end(x, -41, 28)} + CASE WHEN {same} THEN 14 ELSE 0 END)"
    k = "ln((50.0::DOUBLE + 120.0::DOUBLE * sqrt(0.9::DOUBLE)) / 1000)"
    return f"({h}::DOUBLE * -100 / ({s}::DOUBLE * -0.1::DOUBLE + 0.368::DOUBLE * (length({x}) - 1) * {k} + 1.987::DOUBLE * ln(CASE WHEN {same} THEN 5e-8::DOUBLE ELSE 1.25e-8::DOUBLE END)) - 273.15::DOUBLE)"


def sql_stacks() -> str:
    """A table of one row with both maps of `stacks`."""
    each = lambda which: "MAP {" + ", ".join(f"'{k}': {v[which]}" for k, v in stacks().items()) + "}"
    return f"SELECT {each(0)} AS mh, {each(1)} AS ms"


def sql_duplex(lo: str, hi: str) -> str:
    """Temperature between two matched bases of p and a, with lists hs and ss of their stacks."""
    ends = lambda weak, strong: " + ".join(f"(CASE WHEN p[{i}] IN ('A', 'T') THEN {weak} ELSE {strong} END)" for i in (lo, hi))
    h = f"(coalesce(list_sum(hs[{lo}:{hi} - 1]), 0) + {ends(-23, -1)})"
    s = f"(coalesce(list_sum(ss[{lo}:{hi} - 1]), 0) + {ends(-41, 28)})"
    c = pcr.Thermo().conditions
    below = f"({s}::DOUBLE * -0.1::DOUBLE + 0.368::DOUBLE * ({hi} - {lo}) * {math.log(c.monovalent / 1000.0)!r}::DOUBLE + 1.987::DOUBLE * {math.log(c.oligo / 4e9)!r}::DOUBLE)"
    return f"(CASE WHEN {hi} > {lo} AND {h} > 0 AND {below} < 0 THEN {h}::DOUBLE * -100 / {below} - 273.15::DOUBLE ELSE {NO_DUPLEX}::DOUBLE END)"


SQL_THERMO = f"""
{SQL_SITES},
st AS ({sql_stacks()}),
pt AS (SELECT pair, least({sql_tm("forward")}, {sql_tm("reverse")}) AS design_tm FROM pr),
al AS (SELECT n.haplotype, n.contig, n.query AS p, n.strand, n.i AS start, pair, role, design_tm - 5 AS least_tm, CASE WHEN n.strand = '+' THEN w ELSE {sql_revcomp("w")} END AS a FROM near n JOIN roles USING (query) JOIN pt USING (pair)),
li AS (SELECT al.*, substr(p, 19, 2) <> substr(a, 19, 2) AS gated, list_transform(range(1, 21), lambda i: p[i] = a[i] AND contains('ACGT', p[i])) AS same,
  list_transform(range(1, 20), lambda i: coalesce(mh[substr(p, i, 2) || '/' || substr(translate(a, 'ACGT', 'TGCA'), i, 2)], 0)) AS hs, list_transform(range(1, 20), lambda i: coalesce(ms[substr(p, i, 2) || '/' || substr(translate(a, 'ACGT', 'TGCA'), i, 2)], 0)) AS ss FROM al, st),
lh AS (SELECT *, list_position(same, TRUE) AS lo, 21 - list_position(list_reverse(same), TRUE) AS hi FROM li),
tms AS (SELECT *, {sql_duplex("lo", "hi")} AS tm, coalesce(CASE WHEN same[20] THEN list_max(list_transform(list_filter(range(1, 20), lambda i: same[i]), lambda i: {sql_duplex("i", "20")})) END, {NO_DUPLEX}::DOUBLE) AS end_tm FROM lh),
thermo AS (SELECT *, NOT gated AND tm >= least_tm AND end_tm >= least_tm - 10 AS competent, CASE WHEN gated THEN 'mismatch within 3'' terminal 2nt' WHEN tm < least_tm THEN 'annealing Tm ' || printf('%.1f', round_even(tm, 1)) || 'C < ' || printf('%.1f', round_even(least_tm, 1)) || 'C'
  WHEN end_tm < least_tm - 10 THEN '3'' end unstable (Tm ' || printf('%.1f', round_even(end_tm, 1)) || 'C)' ELSE 'annealing Tm ' || printf('%.1f', round_even(tm, 1)) || 'C' END AS reason FROM tms)"""

SQL_METRICS = f"""
{SQL_CELLS},
summed AS (SELECT pair, count(*) AS total, count(*) FILTER (status <> 'uncertain') AS evaluable, count(*) FILTER (status <> 'uncertain' AND n_on > 0) AS n_covered,
  count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'dropout') AS n_dropout, count(*) FILTER (status = 'off_target') AS n_off_target, count(*) FILTER (status = 'multi_product') AS n_multi_product, count(*) FILTER (status = 'uncertain') AS n_uncertain, count(*) FILTER (capped) AS n_capped FROM cells GROUP BY pair),
metrics AS (SELECT summed.*, coalesce(n_covered::DOUBLE / nullif(evaluable, 0), 0.0::DOUBLE) AS coverage, coalesce(n_pass::DOUBLE / nullif(evaluable, 0), 0.0::DOUBLE) AS unique_rate, candidate_idx,
  round(abs({sql_tm("forward")} - 60) + abs({sql_tm("reverse")} - 60), 6) AS penalty, round(least({sql_tm("forward")}, {sql_tm("reverse")}), 6) AS pair_tm FROM summed JOIN pr USING (pair))"""
